"""Validation of uploaded register photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeeper.config import UploadConfig
from rollkeeper.functions.text import strip

# Error codes with their HTTP status and default text.
ERROR_CODES = [
    ("INVALID_IMAGE", 400, "Please upload a valid attendance image."),
    ("FILE_TOO_LARGE", 413, "Image is too large. Maximum size is 10MB."),
    ("NO_ATTENDANCE_DETECTED", 422, "No attendance information could be detected."),
    ("OCR_FAILURE", 500, "Unable to analyze the attendance image."),
    ("MALFORMED_AI_RESPONSE", 502, "AI output validation failed."),
]


def error_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERROR_CODES, "error_code string, http_status int, default_message string")


# Steps of a walk over a file's segments that are taken at once.
BLOCK = 256
_RUNNING, _WHOLE, _BROKEN = 0, 1, 2


def _number(data: Column, at: Column, size: int = 2) -> Column:
    """The big-endian number of ``size`` bytes from a position, which counts from 1."""
    return F.conv(F.hex(F.call_function("substring", data, at.cast("int"), F.lit(size))), 16, 10).cast("bigint")


def _little(data: Column, at: int, size: int) -> Column:
    return sum((_number(data, F.lit(at + i), 1) * (1 << 8 * i) for i in range(size)), F.lit(0))


def _walk(data: Column, start: Column, step) -> Column:
    """The last state of a walk that takes a step at a time until its ``ended`` is set; a file has no more steps than bytes."""

    def block(state: Column, _: Column) -> Column:
        many = F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), state, lambda s, _: F.when(s["ended"] == _RUNNING, step(s)).otherwise(s))
        return F.when(state["ended"] == _RUNNING, many).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(data) / BLOCK)), start, block)


def _jpeg(data: Column) -> Column:
    """Segments up to the scan, each skipped by its length, so nothing in them is taken for a mark; then the end mark anywhere."""
    size = F.length(data)

    def state(pos: Column, width: Column, height: Column, ended: Column) -> Column:
        return F.struct(pos.cast("bigint").alias("pos"), width.cast("bigint").alias("width"), height.cast("bigint").alias("height"), ended.cast("int").alias("ended"))

    def step(s: Column) -> Column:
        pos, mark, length = s["pos"], _number(data, s["pos"] + 1, 1), _number(data, s["pos"] + 2)
        to = lambda at: state(at, s["width"], s["height"], F.lit(_RUNNING))
        end = lambda how: state(pos, s["width"], s["height"], how)
        after = pos + 2 + length
        # A frame header holds the size; C4, C8 and CC are no frames.
        frame = mark.between(0xC0, 0xCF) & ~mark.isin(0xC4, 0xC8, 0xCC)
        # In the scan every FF of the picture is followed by 00, so the mark is the end.
        closed = F.call_function("locate", F.lit("\u00ff\u00d9"), F.decode(data, "ISO-8859-1"), (pos + 2).cast("int")) > 0
        return (
            F.when((pos + 1 > size) | (_number(data, pos, 1) != 0xFF), end(F.lit(_BROKEN)))
            # Any number of FF may stand before a mark.
            .when(mark == 0xFF, to(pos + 1))
            .when(mark == 0xD9, end(F.lit(_WHOLE)))
            .when(mark.between(0xD0, 0xD7) | (mark == 0x01), to(pos + 2))
            .when(mark == 0xDA, end(F.when(closed, _WHOLE).otherwise(_BROKEN)))
            .when((pos + 3 > size) | (length < 2) | (after > size + 1), end(F.lit(_BROKEN)))
            .when(frame, state(after, _number(data, pos + 7), _number(data, pos + 5), F.lit(_RUNNING)))
            .otherwise(to(after))
        )

    none = F.lit(None)
    return _walk(data, state(F.lit(3), none, none, F.lit(_RUNNING)), step)


def _png(data: Column) -> Column:
    """Chunks by their lengths up to the end chunk; what follows it does not matter."""
    size = F.length(data)
    state = lambda pos, ended: F.struct(pos.cast("bigint").alias("pos"), ended.cast("int").alias("ended"))

    def step(s: Column) -> Column:
        pos = s["pos"]
        after = pos + 12 + _number(data, pos, 4)
        return (
            F.when(pos + 11 > size, state(pos, F.lit(_BROKEN)))
            .when(_number(data, pos + 4, 4) == 0x49454E44, state(pos, F.lit(_WHOLE)))
            .when(after > size + 1, state(pos, F.lit(_BROKEN)))
            .otherwise(state(after, F.lit(_RUNNING)))
        )

    return _walk(data, state(F.lit(9), F.lit(_RUNNING)), step)


def read_picture(content: Column) -> Column:
    """``format`` (null: none that is known), ``width``, ``height`` and ``whole``, by the containers' own headers and segments.

    The file must be there up to its end mark and may go on after it. Pictures are not decoded, checksums not verified.
    """
    head = F.hex(F.substring(content, 1, 16))
    size = F.length(content)

    def picture(kind: str, width: Column, height: Column, whole: Column) -> Column:
        return F.struct(F.lit(kind).alias("format"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.coalesce(whole, F.lit(False)).alias("whole"))

    jpeg = F.transform(F.array(_jpeg(content)), lambda s: picture("JPEG", s["width"], s["height"], (s["ended"] == _WHOLE) & s["width"].isNotNull()))
    png = F.transform(
        F.array(_png(content)),
        lambda s: picture("PNG", _number(content, F.lit(17), 4), _number(content, F.lit(21), 4), (s["ended"] == _WHOLE) & (F.substring(head, 25, 8) == "49484452")),
    )
    there = (size >= 30) & (_little(content, 5, 4) + 8 <= size)
    bits = _little(content, 22, 4)
    low = lambda value, n: value.bitwiseAND(F.lit((1 << n) - 1))
    wide = picture("WEBP", _little(content, 25, 3) + 1, _little(content, 28, 3) + 1, there)
    lossless = picture("WEBP", low(bits, 14) + 1, low(F.shiftright(bits, 14), 14) + 1, there & (_number(content, F.lit(21), 1) == 0x2F))
    lossy = picture("WEBP", low(_little(content, 27, 2), 14), low(_little(content, 29, 2), 14), there & (F.hex(F.substring(content, 24, 3)) == "9D012A"))
    none = F.lit(None)
    webp = F.substring(head, 25, 8)
    high = _little(content, 23, 4)
    tall = F.abs(F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high))
    # The first bytes of the formats.
    return (
        F.when(F.startswith(head, F.lit("FFD8")), F.get(jpeg, F.lit(0)))
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), F.get(png, F.lit(0)))
        .when(
            F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"),
            F.when(webp == "56503858", wide).when(webp == "5650384C", lossless).when(webp == "56503820", lossy).otherwise(picture("WEBP", none, none, F.lit(False))),
        )
        .when(head.rlike("^47494638(37|39)61"), picture("GIF", _little(content, 7, 2), _little(content, 9, 2), size >= 13))
        .when(F.startswith(head, F.lit("424D")) & (size >= 26), picture("BMP", _little(content, 19, 4), tall, _little(content, 3, 4) <= size))
        .otherwise(F.struct(none.cast("string").alias("format"), none.cast("int").alias("width"), none.cast("int").alias("height"), F.lit(False).alias("whole")))
    )


def _path_key(path: Column) -> Column:
    """File sources write the scheme in several ways (``file:/`` and ``file:///``)."""
    return F.regexp_replace(path, "^([a-z0-9]+:)/+", "$1/")


def read_uploads(spark: SparkSession, manifest: DataFrame, folder: str, config: UploadConfig = UploadConfig()) -> DataFrame:
    """Manifest rows with the length of their files and what their bytes tell.

    Only files of an acceptable length are read at all. Files that are missing come out with a null length.
    """
    small = spark.read.format("binaryFile").load(folder).filter(F.col("length").between(1, config.max_bytes))
    pictures = small.select(_path_key(F.col("path")).alias("path"), read_picture(F.col("content")).alias("picture"))
    lengths = spark.read.format("binaryFile").load(folder).select(_path_key(F.col("path")).alias("path"), "length")
    files = lengths.join(pictures, "path", "left")
    return manifest.withColumn("path", _path_key(F.col("path"))).join(files, "path", "left")


def clean_content_type(content_type: Column) -> Column:
    return strip(F.split_part(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(";"), F.lit(1)))


def content_type_ok(content_type: Column, filename: Column, config: UploadConfig = UploadConfig()) -> Column:
    """Absent or listed; any other type passes when the file name has a listed ending."""
    clean = clean_content_type(content_type)
    ending = "(?i)(?:" + "|".join(e.replace(".", r"\.") for e in config.extensions) + ")$"
    return (clean == "") | clean.isin(*config.content_types) | F.coalesce(filename.rlike(ending), F.lit(False))


def validate_uploads(uploads: DataFrame, config: UploadConfig = UploadConfig()) -> DataFrame:
    """Add ``image_format``, ``error_code`` (null when fine) and ``error_message``.

    ``uploads`` has ``content_type, filename, length`` and ``picture``, what the file's bytes tell. The first failing
    check decides.
    """
    length = F.coalesce(F.col("length"), F.lit(0))
    kind, whole = F.col("picture.format"), F.coalesce(F.col("picture.whole"), F.lit(False))
    small = (F.col("picture.width") < config.min_side) | (F.col("picture.height") < config.min_side)
    # The messages.
    checks = [
        (length == 0, "INVALID_IMAGE", F.lit("Uploaded file is empty.")),
        (length > config.max_bytes, "FILE_TOO_LARGE", F.lit(f"Image is too large. Maximum size is {config.max_bytes // (1024 * 1024)}MB.")),
        (
            ~content_type_ok(F.col("content_type"), F.col("filename"), config),
            "INVALID_IMAGE",
            F.lit("Please upload a valid attendance image (JPG, PNG, or WebP)."),
        ),
        (kind.isNull(), "INVALID_IMAGE", F.lit("Please upload a valid attendance image.")),
        (~whole, "INVALID_IMAGE", F.lit("Invalid image file or corrupted data.")),
        (
            ~kind.isin("JPEG", "PNG", "WEBP"),
            "INVALID_IMAGE",
            F.concat(F.lit("Unsupported image format: "), kind, F.lit(". Use JPEG, PNG, or WebP.")),
        ),
        (F.coalesce(small, F.lit(True)), "INVALID_IMAGE", F.lit("Image dimensions are too small to detect attendance.")),
    ]
    code = message = None
    for failed, error, text in checks:
        code = F.when(failed, error) if code is None else code.when(failed, error)
        message = F.when(failed, text) if message is None else message.when(failed, text)
    return uploads.select("*", kind.alias("image_format"), code.alias("error_code"), message.alias("error_message"))


def sheets_without_records(uploads: DataFrame, records: DataFrame) -> DataFrame:
    """Accepted uploads of which no valid record came."""
    accepted = uploads.filter(F.col("error_code").isNull()) if "error_code" in uploads.columns else uploads
    return (
        accepted.select("sheet_id")
        .join(records.select("sheet_id").distinct(), "sheet_id", "left_anti")
        .select("sheet_id", F.lit("NO_ATTENDANCE_DETECTED").alias("error_code"))
    )


def with_error_details(errors: DataFrame) -> DataFrame:
    """Add the HTTP status and default text; the code table has five fixed rows."""
    return errors.join(F.broadcast(error_codes(errors.sparkSession)), "error_code", "left")
