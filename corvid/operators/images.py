"""P area: image batches as tables of pixels, chunks and file sizes.

Pixels are ``(image_id, x, y, r, g, b, a)`` with 8-bit channels; scan order
is (y, x). Per-image work is grouped by image, which is bounded by the
image's width x height; colour counting uses partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions.code import basename

# Fixed values.
PALETTE_MAX = 256
FEW_PIXELS = 16           # up to so many, a transparency key does not pay
PNG_SIGNATURE_HEX = "89504E470D0A1A0A"
VALID_DEPTHS = {0: [1, 2, 4, 8, 16], 2: [8, 16], 3: [1, 2, 4, 8], 4: [8, 16], 6: [8, 16]}
# Error codes of the header check, in the order they are tested.
ERR_EMPTY, ERR_SHORT, ERR_SIGNATURE, ERR_HEADER_SIZE, ERR_NO_IHDR = 48, 27, 28, 94, 29
ERR_ZERO_SIZE, ERR_COLOUR_TYPE, ERR_DEPTH = 93, 31, 37
ERR_COMPRESSION, ERR_FILTER, ERR_INTERLACE, ERR_CRC = 32, 33, 34, 57


def packed(r: Column, g: Column, b: Column, a: Column) -> Column:
    return (r.cast("bigint") * 16777216 + g.cast("bigint") * 65536 + b.cast("bigint") * 256 + a.cast("bigint"))


def skip_outputs(files: DataFrame, prefix: str | None, path: str = "path") -> DataFrame:
    """Of a batch of several files, drop those whose base name starts with
    the output prefix; a batch of one file is kept as it is."""
    if not prefix:
        return files
    several = files.select(F.count(F.lit(1)) > 1).scalar()
    return files.where(~(basename(path).startswith(prefix) & several))


def colour_counts(pixels: DataFrame, transparent_as_one: bool = False) -> DataFrame:
    """Distinct RGBA colours per image, and whether a palette holds them.

    With ``transparent_as_one`` every alpha-0 pixel counts as one colour.
    """
    col = packed(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    if transparent_as_one:
        col = F.when(F.col("a") == 0, F.lit(-1).cast("bigint")).otherwise(col)
    return (pixels.groupBy("image_id").agg(F.count_distinct(col).alias("colours"))
            .withColumn("fits_palette", F.col("colours") <= PALETTE_MAX))


def colour_table(pixels: DataFrame) -> DataFrame:
    """One row per (image, RGBA colour) with its pixel count and first place:
    everything that the profile needs, pre-aggregated map-side."""
    return (pixels.groupBy("image_id", "r", "g", "b", "a")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("y", "x")).alias("first")))


def _bits(v: Column) -> Column:
    """Bits a channel value needs: 1, 2, 4 or 8 (exact downscaling)."""
    return (F.when((v == 0) | (v == 255), 1).when(v % 85 == 0, 2).when(v % 17 == 0, 4).otherwise(8))


def colour_profile(pixels: DataFrame) -> DataFrame:
    """Per image: coloured, transparency key possible, alpha channel
    needed, bits per channel, exact colour count and pixels.

    A key is possible when there is a transparent pixel, all of them share one
    RGB, no pixel is partly transparent and no opaque pixel has that RGB.
    Alpha is needed when some pixel is not opaque and no key is possible. Only
    grey images without alpha need fewer than 8 bits.
    """
    c = colour_table(pixels)
    # an RGB that is transparent somewhere and opaque elsewhere can't be a key
    per_rgb = c.groupBy("image_id", "r", "g", "b").agg(
        F.bool_or(F.col("a") == 0).alias("clear"), F.bool_or(F.col("a") == 255).alias("opaque"),
        F.bool_or((F.col("a") > 0) & (F.col("a") < 255)).alias("partly"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    image = per_rgb.groupBy("image_id").agg(
        F.bool_or((F.col("r") != F.col("g")) | (F.col("r") != F.col("b"))).alias("coloured"),
        F.count_if("clear").alias("_keys"), F.bool_or(F.col("clear") & F.col("opaque")).alias("_clash"),
        F.bool_or("partly").alias("_partly"), F.max(_bits(F.col("r"))).alias("_bits"),
        F.sum("kinds").alias("colours"), F.sum("n").alias("n_pixels"))
    key = (F.col("_keys") == 1) & ~F.col("_clash") & ~F.col("_partly")
    alpha = ((F.col("_keys") > 0) | F.col("_partly")) & ~key
    bits = F.when(F.col("coloured") | alpha, F.lit(8)).otherwise(F.col("_bits"))
    return image.select("image_id", "coloured", key.alias("key_possible"), alpha.alias("alpha_needed"),
                        bits.cast("int").alias("bits"), "colours", "n_pixels")


def minimal_colour_mode(profile: DataFrame) -> DataFrame:
    """The PNG mode of the fewest bits for a profile, and its bit depth.

    A key does not pay for up to 16 pixels: an alpha channel takes its place.
    A palette needs at most 256 colours and two pixels a colour, and yields to
    a grey mode that is as narrow.
    """
    few = F.col("key_possible") & (F.col("n_pixels") <= FEW_PIXELS)
    alpha, key = F.col("alpha_needed") | few, F.col("key_possible") & ~few
    grey = ~F.col("coloured")
    bits = F.when(few | ~grey, F.greatest("bits", F.lit(8))).otherwise(F.col("bits"))
    n = F.col("colours")
    palette_bits = F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 16, 4).otherwise(8)
    palette = ((n > 0) & (n <= PALETTE_MAX) & (bits <= 8) & (F.col("n_pixels") >= 2 * n)
               & ~(grey & ~alpha & (bits <= palette_bits)))
    base = F.when(grey, "grey").otherwise("rgb")
    other = F.when(alpha, F.when(grey, "grey+alpha").otherwise("rgba")).when(key, F.concat(base, F.lit("+key"))).otherwise(base)
    return profile.withColumn("mode", F.when(palette, "palette").otherwise(other)).withColumn(
        "mode_bits", F.when(palette, palette_bits).otherwise(bits).cast("int"))


def clean_transparent(pixels: DataFrame) -> DataFrame:
    """Set the RGB of fully transparent pixels so they compress well.

    All get the RGB of the first transparent pixel when no pixel is partly
    transparent or a palette can hold the colours (all transparent ones
    counted as one); else each gets the RGB of the last pixel before it that
    is not transparent (black before any). That one is looked for in the
    pixel's own image row first, then among one value a row above it.
    """
    c = colour_table(pixels)
    clear = F.col("a") == 0
    image = c.groupBy("image_id").agg(
        F.bool_or((F.col("a") > 0) & (F.col("a") < 255)).alias("_partly"),
        (F.count_if(~clear) + F.max(clear.cast("int"))).alias("_colours"),
        F.min(F.when(clear, F.struct("first", "r", "g", "b"))).alias("_ft"))
    image = image.select("image_id", "_ft", (~F.col("_partly") | (F.col("_colours") <= PALETTE_MAX)).alias("_same"))
    rgb = F.struct("r", "g", "b")
    rows = pixels.groupBy("image_id", "y").agg(F.max(F.when(~clear, F.struct("x", "r", "g", "b"))).alias("_end"))
    above = Window.partitionBy("image_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("image_id", "y", F.last("_end", ignorenulls=True).over(above).alias("_above")).join(image, "image_id")
    own = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    x = pixels.withColumn("_own", F.last(F.when(~clear, rgb), ignorenulls=True).over(own)).join(rows, ["image_id", "y"])

    def chan(name):
        last = F.coalesce(F.col(f"_own.{name}"), F.col(f"_above.{name}"), F.lit(0))
        return F.when(clear & F.col("_same"), F.col(f"_ft.{name}")).when(clear, last).otherwise(F.col(name)).alias(name)
    return x.select("image_id", "x", "y", chan("r"), chan("g"), chan("b"), "a")


def verify_pairs(a: DataFrame, b: DataFrame, lossy: bool | None = None) -> DataFrame:
    """Same pixel set and equal pixels, per image, in one full outer join.

    ``strict_ok``: every pixel equal; ``lossy_ok``: the RGB of pixels
    transparent in both is ignored. With ``lossy`` set, only that flag is
    returned as ``ok`` (False -> revert to the original).
    """
    x = a.select("image_id", "x", "y", *[F.col(c).alias(f"{c}1") for c in "rgba"])
    y = b.select("image_id", "x", "y", *[F.col(c).alias(f"{c}2") for c in "rgba"])
    j = x.join(y, ["image_id", "x", "y"], "full_outer")
    both = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    eq_a = F.col("a1") == F.col("a2")
    eq_rgb = (F.col("r1") == F.col("r2")) & (F.col("g1") == F.col("g2")) & (F.col("b1") == F.col("b2"))
    strict = both & eq_a & eq_rgb
    loose = both & eq_a & (eq_rgb | (F.col("a1") == 0))
    out = j.groupBy("image_id").agg(F.bool_and(F.coalesce(strict, F.lit(False))).alias("strict_ok"),
                                    F.bool_and(F.coalesce(loose, F.lit(False))).alias("lossy_ok"))
    if lossy is None:
        return out
    return out.select("image_id", F.col("lossy_ok" if lossy else "strict_ok").alias("ok"))


def chunks_to_keep(chunks: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Per image, the distinct wanted chunk names that occur.

    ``wanted`` is a short configuration list, so the semi join is an ``isin``.
    """
    return chunks.where(F.col("name").isin(*wanted)).select("image_id", "name").distinct()


def keep_better(files: DataFrame, force: bool = False, use_prefix: bool = False) -> DataFrame:
    """Keep the earlier output when it exists and the new one is not
    smaller, unless forced; only where outputs have a prefix or the output has
    the input's name. ``files``: (name, out_name, out_size, old_size NULL-able)."""
    own = F.lit(True) if use_prefix else F.col("name") == F.col("out_name")
    keep_old = F.col("old_size").isNotNull() & (F.col("out_size") >= F.col("old_size")) & own & F.lit(not force)
    return files.withColumns({
        "kept": F.when(keep_old, "old").otherwise("new"),
        "final_size": F.when(keep_old, F.col("old_size")).otherwise(F.col("out_size")),
    })


def size_report(files: DataFrame, force: bool = False, use_prefix: bool = False) -> DataFrame:
    """P5: one row: files tried / smaller / equal / errors, bytes saved, total
    in and out (error files excluded) and percent of the original (NULL when
    nothing went in)."""
    f = keep_better(files, force, use_prefix)
    ok = ~F.col("error")
    fin, inn = F.col("final_size"), F.col("in_size")
    rep = f.agg(
        F.count(F.lit(1)).alias("tried"),
        F.count_if(ok & (fin < inn)).alias("smaller"),
        F.count_if(ok & (fin == inn)).alias("equal"),
        F.count_if(F.col("error")).alias("errors"),
        F.coalesce(F.sum(F.when(ok & (fin < inn), inn - fin)), F.lit(0)).cast("bigint").alias("saved"),
        F.coalesce(F.sum(F.when(ok, inn)), F.lit(0)).cast("bigint").alias("total_in"),
        F.coalesce(F.sum(F.when(ok, fin)), F.lit(0)).cast("bigint").alias("total_out"))
    return rep.withColumn("percent", F.round(F.try_divide(F.col("total_out") * 100.0, F.col("total_in")), 3))


# ------------------------------------------------------------ PNG bytes
def _u32(blob: Column, pos: int) -> Column:
    return F.conv(F.hex(F.substring(blob, pos, 4)), 16, 10).cast("bigint")


def _u8(blob: Column, pos: int) -> Column:
    return F.conv(F.hex(F.substring(blob, pos, 1)), 16, 10).cast("int")


def image_header(blob: Column) -> Column:
    """P10: struct(width, height, depth, colour_type, interlace, error) of PNG bytes.

    The first failing check sets ``error`` (0 = fine), in the reference's order.
    """
    n = F.length(blob)
    width, height = _u32(blob, 17), _u32(blob, 21)
    depth, ctype = _u8(blob, 25), _u8(blob, 26)
    comp, filt, inter = _u8(blob, 27), _u8(blob, 28), _u8(blob, 29)
    crc_stored = _u32(blob, 30)
    crc_calc = F.crc32(F.substring(blob, 13, 17))
    depth_ok = F.lit(False)
    for ct, ds in VALID_DEPTHS.items():
        depth_ok = depth_ok | ((ctype == ct) & depth.isin(*ds))
    err = (F.when(n == 0, ERR_EMPTY)
           .when(n < 33, ERR_SHORT)
           .when(F.hex(F.substring(blob, 1, 8)) != PNG_SIGNATURE_HEX, ERR_SIGNATURE)
           .when(_u32(blob, 9) != 13, ERR_HEADER_SIZE)
           .when(F.substring(blob, 13, 4) != F.encode(F.lit("IHDR"), "UTF-8"), ERR_NO_IHDR)
           .when((width == 0) | (height == 0), ERR_ZERO_SIZE)
           .when(~ctype.isin(*VALID_DEPTHS.keys()), ERR_COLOUR_TYPE)
           .when(~depth_ok, ERR_DEPTH)
           .when(comp != 0, ERR_COMPRESSION)
           .when(filt != 0, ERR_FILTER)
           .when(inter > 1, ERR_INTERLACE)
           .when(crc_stored != crc_calc, ERR_CRC)
           .otherwise(0))
    good = err == 0
    return F.struct(F.when(good, width).alias("width"), F.when(good, height).alias("height"),
                    F.when(good, depth).alias("depth"), F.when(good, ctype).alias("colour_type"),
                    F.when(good, inter).alias("interlace"), err.alias("error"))


def png_chunk(name: str | Column, data: Column) -> Column:
    """Bytes of one PNG chunk: length, type, data, CRC of type+data."""
    tname = F.encode(F.lit(name) if isinstance(name, str) else name, "UTF-8")
    body = F.concat(tname, data)
    return F.concat(F.unhex(F.lpad(F.hex(F.length(data)), 8, "0")), body,
                    F.unhex(F.lpad(F.hex(F.crc32(body)), 8, "0")))


def png_bytes(width: Column, height: Column, extra_chunks: Column | None = None,
              depth: int = 8, colour_type: int = 6) -> Column:
    """Signature + IHDR (+ given chunks) + empty IDAT + IEND, for tests and fixtures."""
    ihdr = F.concat(F.unhex(F.lpad(F.hex(width), 8, "0")), F.unhex(F.lpad(F.hex(height), 8, "0")),
                    F.unhex(F.lit(f"{depth:02X}{colour_type:02X}000000")))
    parts = [F.unhex(F.lit(PNG_SIGNATURE_HEX)), png_chunk("IHDR", ihdr)]
    if extra_chunks is not None:
        parts.append(extra_chunks)
    parts += [png_chunk("IDAT", F.unhex(F.lit(""))), png_chunk("IEND", F.unhex(F.lit("")))]
    return F.concat(*parts)


CHUNK_SCHEMA = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("ancillary", T.BooleanType()), T.StructField("private", T.BooleanType()),
    T.StructField("safe_to_copy", T.BooleanType()), T.StructField("location", T.IntegerType()),
    T.StructField("crc_ok", T.BooleanType()), T.StructField("error", T.StringType())])


def image_chunks(images: DataFrame, key: str = "image_id", data: str = "data") -> DataFrame:
    """One row per chunk after the signature: ordinal, name, data length,
    property bits (case of letters 1, 2 and 4), location group (0 before
    PLTE, 1 between PLTE and IDAT, 2 after IDAT) and CRC check. The walk ends
    at IEND. A truncated chunk, an end without IEND and a blob that is NULL or
    not longer than the signature give an error row. Variable-length walk:
    mapInPandas.
    """
    def walk(batches):
        import zlib

        import pandas as pd
        for pdf in batches:
            rows = []
            for iid, blob in zip(pdf[key], pdf[data]):
                b = bytes(blob) if blob is not None else b""
                pos, ordinal, loc = 8, 0, 0
                while True:
                    if pos + 12 > len(b):
                        rows.append((iid, ordinal, None, None, None, None, None, loc, None, "truncated"))
                        break
                    length = int.from_bytes(b[pos:pos + 4], "big")
                    name = b[pos + 4:pos + 8].decode("latin-1")
                    if pos + 12 + length > len(b):
                        rows.append((iid, ordinal, name, length, None, None, None, loc, None, "truncated"))
                        break
                    payload = b[pos + 8:pos + 8 + length]
                    crc = int.from_bytes(b[pos + 8 + length:pos + 12 + length], "big")
                    if name == "PLTE":
                        loc = max(loc, 1)
                    if name == "IDAT":
                        loc = 2
                    low = [bool(ord(ch) & 0x20) for ch in name]
                    rows.append((iid, ordinal, name, length, low[0], low[1], low[3], loc, zlib.crc32(b[pos + 4:pos + 8] + payload) == crc, None))
                    if name == "IEND":
                        break
                    ordinal += 1
                    pos += 12 + length
            yield pd.DataFrame(rows, columns=CHUNK_SCHEMA.fieldNames())

    return images.select(F.col(key).cast("long").alias("image_id"), F.col(data)).mapInPandas(walk, CHUNK_SCHEMA)
