"""Image rows: which ones to read, what their text becomes, what is reported about them.

Recognition itself is the caller's; these operators decide what it is given and shape what it
returns. Payload bytes are never grouped or sorted beyond what an operator needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.functions import regex, text
from veilwork.functions.scale import running_before
from veilwork.options import RedactOptions

IMAGE_BUCKET = 1 << 14


def dedupe_page_images(images: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """First image of every (document, page, xref); a repeat on another page stays.

    The filter on the row number lets Spark cut each group to one row before the shuffle.
    """
    first = Window.partitionBy(id_col, "page", "xref").orderBy("img_idx")
    return images.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def image_format_column(data: Column) -> Column:
    """Format named by the leading bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "GIF")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
        .when(head.startswith("424D"), "BMP")
        .otherwise("unknown")
    )


def image_format(df: DataFrame, col: str = "image_data") -> DataFrame:
    return df.withColumn("image_format", image_format_column(F.col(col)))


def pixel_stats(df: DataFrame, col: str = "pixels") -> DataFrame:
    """Add ``stddev`` (of the population) and ``dark_share`` (grey below 110) of a grey sample."""
    n = F.nullif(F.size(col), F.lit(0))

    def total(f):
        return F.aggregate(F.col(col), F.lit(0.0), lambda acc, p: acc + f(p.cast("double")))

    mean = total(lambda p: p) / n
    spread = df.withColumn("_mean", mean).withColumn(
        "stddev", F.sqrt(total(lambda p: (p - F.col("_mean")) * (p - F.col("_mean"))) / n)
    )
    dark = F.size(F.filter(F.col(col), lambda p: p < 110)) / n
    return spread.withColumn("dark_share", dark).drop("_mean")


def image_text_likelihood(df: DataFrame) -> DataFrame:
    """Add ``likely`` from (width, height, stddev, dark_share): tiny, flat or pale images hold no text.

    An image that could not be measured is given the benefit of the doubt.
    """
    unlikely = (
        (F.col("width") < 32)
        | (F.col("height") < 32)
        | (F.col("width").cast("long") * F.col("height") < 2000)
        | (F.col("stddev") < 8)
        | (F.col("dark_share") < 0.01)
    )
    return df.withColumn("likely", F.coalesce(~unlikely, F.lit(True)))


def ocr_mode_reason(opts: RedactOptions) -> Column:
    """Why no image is read at all, or NULL."""
    if opts.throughput:
        return F.lit(patterns.OCR_REASONS["throughput"])
    if not opts.ocr_enabled:
        return F.lit(patterns.OCR_REASONS["disabled"])
    if not opts.ocr_available:
        return F.lit(patterns.OCR_REASONS["missing"])
    return F.lit(None).cast("string")


def ocr_reason(opts: RedactOptions, has_data: Column, likely: Column, earlier: Column | None) -> Column:
    """Why one image is not read, or NULL; ``earlier`` counts readable images of its document before it."""
    if opts.throughput or not opts.ocr_enabled or not opts.ocr_available:
        return ocr_mode_reason(opts)
    reason = F.when(~has_data, patterns.OCR_REASONS["no_data"]).when(~likely, patterns.OCR_REASONS["unlikely"])
    if opts.max_images is None:
        return reason
    return F.when(earlier >= opts.max_images, patterns.OCR_REASONS["cap"]).otherwise(reason)


def ocr_gate(images: DataFrame, opts: RedactOptions = RedactOptions(), id_col: str = "doc_id") -> DataFrame:
    """Add ``eligible`` and ``extracted_text`` (the reason, for images that are skipped).

    Needs (id, idx, has_data, likely). Without ``max_images`` there is no cap. Only earlier eligible
    images count towards one, and it is tested first; an image past the cap is never eligible, so
    counting earlier readable ones gives the same answer.
    """
    if opts.max_images is not None and ocr_runs(opts):
        readable = (F.col("has_data") & F.col("likely")).cast("int")
        images = running_before(images, [id_col], ["idx"], readable, "_before", bucket=IMAGE_BUCKET)
    earlier = F.col("_before") if "_before" in images.columns else None
    gated = images.withColumn("extracted_text", ocr_reason(opts, F.col("has_data"), F.col("likely"), earlier))
    return gated.withColumn("eligible", F.col("extracted_text").isNull()).drop("_before")


def ocr_runs(opts: RedactOptions) -> bool:
    return opts.ocr_enabled and opts.ocr_available and not opts.throughput


def _has_bytes(image: Column) -> Column:
    return F.coalesce(F.octet_length(image["image_data"]), F.lit(0)) > 0


def ocr_entries(
    images: Column,
    opts: RedactOptions,
    read: Column | None = None,
    has_data: Callable[[Column], Column] = _has_bytes,
    likely: Callable[[Column], Column] = lambda image: F.lit(True),
) -> Column:
    """Image entries of one document, in order, through the gate: the same as ``ocr_apply`` on rows.

    ``read`` maps places to the texts a recogniser found; ``eligible`` stays for counting. The cap is one
    place, behind which no image is read, so the work is linear in the images.
    """
    capped = None
    if opts.max_images:
        readable = F.transform(images, lambda image, at: F.when(has_data(image) & likely(image), at))
        capped = F.get(F.filter(readable, lambda at: at.isNotNull()), F.lit(opts.max_images - 1))

    def entry(pair: Column, at: Column) -> Column:
        image = pair["image"]
        earlier = F.lit(0) if capped is None else F.when(at > pair["capped"], opts.max_images).otherwise(0)
        reason = ocr_reason(opts, has_data(image), likely(image), earlier)
        text_of = F.try_element_at(read, image["idx"]) if read is not None else F.lit(None).cast("string")
        return (
            image.withField("extracted_text", F.coalesce(text_of, reason, F.lit("")))
            .withField("ocr_applied", text_of.isNotNull())
            .withField("eligible", reason.isNull())
        )

    # The cap is worked out once for the array and repeated beside each image.
    caps = F.array_repeat(F.lit(None).cast("int") if capped is None else capped, F.coalesce(F.size(images), F.lit(0)))
    return F.transform(F.zip_with(images, caps, lambda i, c: F.named_struct(F.lit("image"), i, F.lit("capped"), c)), entry)


def first_of_runs(ordered: Column, same: Callable[[Column], Column]) -> Column:
    """Of a sorted array the first entry of each run of entries that ``same`` maps alike."""
    before = F.slice(F.concat(F.array(F.lit(None)), ordered), F.lit(1), F.size(ordered))
    pairs = F.zip_with(ordered, before, lambda i, b: F.named_struct(F.lit("own"), i, F.lit("before"), b))
    firsts = F.filter(pairs, lambda p: p["before"].isNull() | ~same(p["own"]).eqNullSafe(same(p["before"])))
    return F.transform(firsts, lambda p: p["own"])


def ocr_apply(
    images: DataFrame, opts: RedactOptions = RedactOptions(), recognised: DataFrame | None = None, id_col: str = "doc_id"
) -> DataFrame:
    """Images with the text read from them, or the reason why none was.

    ``recognised`` holds (id, idx, extracted_text) for images a recogniser was given; a text that is
    there is kept whatever the gate says. Only places and flags go through the gate; payloads travel
    in the last join if they are used after it.
    """
    likely = F.coalesce("likely", F.lit(True)) if "likely" in images.columns else F.lit(True)
    has_data = F.coalesce(F.octet_length("image_data"), F.lit(0)) > 0 if "image_data" in images.columns else F.lit(True)
    flags = images.select(id_col, "idx", has_data.alias("has_data"), likely.alias("likely"))
    gated = ocr_gate(flags, opts, id_col).select(id_col, "idx", "eligible", F.col("extracted_text").alias("_reason"))
    if recognised is None:
        read = gated.withColumn("_read", F.lit(None).cast("string"))
    else:
        texts = recognised.select(id_col, "idx", F.col("extracted_text").alias("_read"))
        read = gated.join(texts, [id_col, "idx"], "left")
    return (
        images.drop("extracted_text", "ocr_applied")
        .join(read, [id_col, "idx"], "left")
        .withColumn("extracted_text", F.coalesce("_read", "_reason", F.lit("")))
        .withColumn("ocr_applied", F.col("_read").isNotNull())
        .drop("_reason", "_read", "eligible")
    )


def ocr_join_text(lines: DataFrame, *keys: str) -> DataFrame:
    """Recognised lines of an image (keys, pos, line[, error]) as one clean text, or why there is none."""
    keys = keys or ("doc_id", "idx")
    error = F.max("error") if "error" in lines.columns else F.lit(None).cast("string")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    joined = text.collapse_space(F.array_join(F.transform(ordered, lambda x: x["line"]), " "))
    gathered = lines.groupBy(*keys).agg(joined.alias("_text"), error.alias("_error"))
    return gathered.select(
        *keys,
        F.when(F.col("_error").isNotNull(), F.concat(F.lit("[OCR failed: "), "_error", F.lit("]")))
        .otherwise(F.coalesce(F.nullif("_text", F.lit("")), F.lit(patterns.OCR_REASONS["no_text"])))
        .alias("extracted_text"),
    )


def ocr_counters(gated: DataFrame, opts: RedactOptions = RedactOptions(), id_col: str = "doc_id") -> DataFrame:
    """Images read and skipped per document with the settings that applied."""
    return gated.groupBy(id_col).agg(
        F.count_if("eligible").alias("images_processed"),
        F.count_if(~F.col("eligible")).alias("images_skipped"),
        F.lit(opts.max_images).cast("int").alias("max_images_per_doc"),
        F.lit(opts.ocr_enabled and not opts.throughput).alias("enabled"),
    )


def image_info(images: DataFrame, *keep: str) -> DataFrame:
    """What a record says about an image, with defaults for what is not known."""
    keep = keep or ("doc_id", "idx")
    defaults = {"type": "unknown", "description": "", "extracted_text": "", "ocr_applied": False, "image_format": "unknown"}
    return images.select(
        *keep,
        *[
            (F.coalesce(name, F.lit(value)) if name in images.columns else F.lit(value)).alias(name)
            for name, value in defaults.items()
        ],
    )


def thumbnail_eligible(df: DataFrame, limit: int | None = None, col: str = "image_data") -> DataFrame:
    """Images with bytes, below ``limit`` bytes where one is given."""
    size = F.octet_length(col)
    small = size.isNotNull() if limit is None else size < limit
    return df.withColumn("thumbnail_eligible", F.coalesce(small, F.lit(False)))


def mentioned_images(c: Column) -> Column:
    """Alternative texts of the image references in a text, each once, in order of first mention."""
    pattern = F.lit(regex.IMAGE_REFERENCE_JAVA)
    groups = F.zip_with(
        F.regexp_extract_all(c, pattern, F.lit(1)),
        F.regexp_extract_all(c, pattern, F.lit(2)),
        lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b),
    )
    found = F.array_distinct(F.filter(groups, lambda a: a != ""))
    return F.when(c.contains("["), found).otherwise(F.array().cast("array<string>"))


def referenced_images(
    docs: DataFrame, images: DataFrame | None = None, id_col: str = "doc_id", col: str = "text"
) -> DataFrame:
    """Images the text refers to and no image row describes: (id, pos, type, description, ...).

    Repeats are dropped inside the row, so the anti join has at most one row per alternative text;
    its other side is reduced to distinct descriptions before it is shuffled.
    """
    refs = docs.select(id_col, F.posexplode(mentioned_images(F.col(col))).alias("pos", "description"))
    if images is not None:
        known = images.select(id_col, F.coalesce("description", F.lit("")).alias("description")).distinct()
        refs = refs.join(known, [id_col, "description"], "left_anti")
    return refs.select(
        id_col,
        "pos",
        F.lit("referenced_image").alias("type"),
        "description",
        F.concat(F.lit("Referenced image: "), "description").alias("extracted_text"),
        F.lit(False).alias("ocr_applied"),
    )


def drop_logo_images(df: DataFrame, trim: bool = False, col: str = "extracted_text") -> DataFrame:
    """Drop images that show nothing but a logo. Reports trim the text first, records do not."""
    shown = F.coalesce(col, F.lit(""))
    return df.where(~F.lower(text.strip(shown) if trim else shown).isin(*patterns.LOGO_TEXTS))


def fit_image_width(df: DataFrame) -> DataFrame:
    """Add ``fit_width`` and ``fit_height``: at most 400 wide; 400 x 300 where the size is unknown."""
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    wide = F.col("width") > patterns.REPORT_IMAGE_WIDTH
    ratio = F.lit(float(patterns.REPORT_IMAGE_WIDTH)) / F.nullif("width", F.lit(0))
    return df.withColumn(
        "fit_width",
        F.when(~known | wide, F.lit(patterns.REPORT_IMAGE_WIDTH)).otherwise(F.col("width")).cast("int"),
    ).withColumn(
        "fit_height",
        F.when(~known, F.lit(patterns.REPORT_IMAGE_HEIGHT))
        .when(wide, (F.col("height") * ratio).cast("int"))
        .otherwise(F.col("height"))
        .cast("int"),
    )
