"""Decision tables: admission, compression levels, item checks, image protection, delivery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels with their colour resolution; least saving; bytes of a large file.
LEVELS = {"low": 300, "recommended": 150, "extreme": 72}
DEFAULT_LEVEL, MIN_SAVING, LARGE_BYTES = "recommended", 0.02, 50 * 1024 * 1024
#: Colours and pixels up to which an image is kept lossless, and the lossy encodings.
MAX_COLORS, MAX_PIXELS, LOSSY = 16, 40_000_000, ["DCTDecode", "JPXDecode"]
#: Bytes of an upload and milliseconds of a compression and of a redaction in each plan; fields of the form
#: with their bytes by route; bytes of a list of items.
MB = 1024 * 1024
PLANS = {"free": (50 * MB, 180_000, 240_000), "pro": (100 * MB, 330_000, 240_000)}
ITEMS_BYTES = 16 * MB
FIELDS = {"compress": (4, MB), "search": (4, MB), "apply": (2, ITEMS_BYTES + 1)}
#: Exit codes of a process for a file with a password and for bad patterns.
ENCRYPTED, BAD_PATTERNS = 3, 4
#: How much larger than its original a lossless copy may be before the original counts as truncated.
TRUNCATED_RATIO = 1.5
#: An https origin without port, path or trailing stroke.
ORIGIN = r"^https://[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+\z"


def env_int(raw: Column, default: int) -> Column:
    """The whole number that a setting begins with, if it is not negative, or the default."""
    digits = F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\s*\+?(\d+)", 1)
    return F.coalesce(F.try_to_number(F.when(digits != "", digits), F.lit("9" * 18)).cast("long"), F.lit(default))


def job_weight(size: Column) -> Column:
    return F.when(size > LARGE_BYTES, 2).otherwise(1)


def effective_level(level: Column) -> Column:
    return F.when(level.isin(*LEVELS), level).otherwise(F.lit(DEFAULT_LEVEL))


def saves_enough(size_in: Column, size_out: Column) -> Column:
    """Null where the result can't be read."""
    return size_out <= size_in * (1 - MIN_SAVING)


def percent_change(base: Column, new: Column) -> Column:
    return F.when(base > 0, (new - base) * 100 / base).otherwise(F.lit(float("nan")))


def compression_choice(level: Column, size_in: Column, out: Column, fallback_out: Column, verified: Column, fallback_verified: Column, in_time: Column | None = None) -> Column:
    """What is delivered: the level asked for if it saves enough, else the lossless one, else the original. Delivery
    needs a verified file; a failed verification gives the original, it does not go on to the next. A result whose size
    can't be read (null) is an error. Without time left (in_time) there is no second try."""
    original, first, second = F.lit("original"), saves_enough(size_in, out), saves_enough(size_in, fallback_out)
    deliver = lambda ok, what: F.when(F.coalesce(ok, F.lit(False)), what).otherwise(original)
    over = (level == "low") | ~F.coalesce(in_time if in_time is not None else F.lit(True), F.lit(False))
    return (
        F.when(first.isNull(), F.lit("error"))
        .when(first, deliver(verified, level))
        .when(over, original)
        .when(second.isNull(), F.lit("error"))
        .when(second, deliver(fallback_verified, F.lit("low")))
        .otherwise(original)
    )


def item_error(page: Column, pages: Column, coords: list[Column], width: Column, height: Column, rotation: Column) -> Column:
    """Why an item can't be masked as it stands, or null. A turned page's visible size is turned back first."""
    x0, y0, x1, y1 = coords
    finite = reduce(lambda a, b: a & b, (c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in coords))
    w, h = unrotated(rotation, width, height)
    return (
        F.when(page.isNull() | (page < 0) | pages.isNull() | (page >= pages), F.lit("page not in document"))
        .when(~finite, F.lit("rect not valid"))
        .when((x0 >= x1) | (y0 >= y1), F.lit("rect inverted or empty"))
        .when((x0 >= w) | (x1 <= 0) | (y0 >= h) | (y1 <= 0), F.lit("rect off the page"))
    )


def lossless_image(mask: Column, bits: Column, palette_top: Column, used_indices: Column, encoding: Column, width: Column, height: Column, colors: Column) -> Column:
    """Whether an image must not be compressed with loss: masks, one bit, few colours."""
    lossy = reduce(lambda a, b: a | b, (F.coalesce(F.contains(encoding, F.lit(x)), F.lit(False)) for x in LOSSY))
    return (
        F.when(F.coalesce(mask, F.lit(False)) | (F.coalesce(bits, F.lit(0)) == 1) | (F.coalesce(palette_top, F.lit(1 << 30)) < MAX_COLORS), True)
        .when(palette_top.isNotNull() & (bits == 8), F.coalesce(used_indices <= MAX_COLORS, F.lit(False)))
        .when(lossy | width.isNull() | height.isNull(), False)
        .when(width.cast("long") * height > MAX_PIXELS, False)
        .otherwise(F.coalesce(colors <= MAX_COLORS, F.lit(False)))
    )


def valid_origin(origin: Column) -> Column:
    return origin.rlike(r"^https?://[A-Za-z0-9.-]+(:\d{1,5})?\z")


def is_uuid(value: Column) -> Column:
    return value.rlike(r"^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")


def looks_like_pdf(data: Column) -> Column:
    """Begins with the mark and has the end mark in its last 64 bytes."""
    tail = F.substring(F.hex(data), -128, 128)
    return F.startswith(F.hex(data), F.lit("255044462D")) & F.contains(tail, F.lit("2525454F46"))


def plan_limits(spark: SparkSession) -> DataFrame:
    """The plans as a dimension table: plan, upload_bytes, compress_ms, redact_ms."""
    return spark.createDataFrame([(k, *v) for k, v in PLANS.items()], "plan string, upload_bytes long, compress_ms long, redact_ms long")


def upload_verdict(route: Column, limit: Column, announced: Column, size: Column, items_bytes: Column) -> Column:
    """Why an upload is turned away, or null: what it announces is beyond the plan's limit and the form's margin, the file
    itself is, or the list of items is."""
    margin = reduce(lambda acc, kv: acc.when(route == kv[0], F.lit(kv[1][0] * kv[1][1] + MB)), list(FIELDS.items()), F.when(F.lit(False), F.lit(0)))
    return (
        F.when(announced.isNotNull() & (announced > limit + margin), F.lit("FILE_TOO_LARGE_ANNOUNCED"))
        .when(size > limit, F.lit("FILE_TOO_LARGE"))
        .when((route == "apply") & (items_bytes > ITEMS_BYTES), F.lit("ITEMS_TOO_LARGE"))
    )


def allowed_origins(base: list[str], extra: Column) -> Column:
    """The origins that may post: the given ones and those of a comma-separated setting that are plain https origins."""
    more = F.filter(F.transform(F.split(F.coalesce(extra, F.lit("")), ","), lambda o: F.trim(o)), lambda o: o.rlike(ORIGIN))
    return F.array_union(F.array(*map(F.lit, base)).cast("array<string>"), more)


def origin_refused(method: Column, origin: Column, allowed: Column) -> Column:
    """Posts need an allowed origin; other methods don't."""
    return (method == "POST") & ~F.coalesce(F.array_contains(allowed, origin), F.lit(False))


def exec_status(exit_code: Column, killed: Column, signal: Column, route: Column) -> Column:
    """The answer to a request whose process ended so: 200, 400 for bad patterns of a search, 422 for a password, 504 for
    the time limit, else 500."""
    late = F.coalesce(killed, F.lit(False)) & F.coalesce(signal == "SIGKILL", F.lit(False))
    return (
        F.when(late, 504)
        .when(exit_code == ENCRYPTED, 422)
        .when((exit_code == BAD_PATTERNS) & (route == "search"), 400)
        .when(exit_code == 0, 200)
        .otherwise(500)
    )


def request_status(origin_no: Column, too_large: Column, limited: Column, full: Column, fields_ok: Column, ended: Column) -> Column:
    """The answer to a request as it goes through the checks, the first that fails telling: 403 for its origin, 413 for its size,
    429 for its client's limit, 503 where there is no slot, 400 for its fields, then how its process ended (exec_status)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(origin_no), 403).when(yes(too_large), 413).when(yes(limited), 429).when(yes(full), 503).when(~yes(fields_ok), 400).otherwise(ended)


def recompression(bits: Column, colors: Column, components: Column, encoding: Column, reversible: Column, lossless_size: Column, original_size: Column, flate_size: Column, has_tables: Column) -> Column:
    """How a redacted copy of an image is stored: one bit as G4, few colours and what nothing else fits as flate, JPEG with
    the original's tables (or by quality, if they can't be read), JPEG 2000 as it was: lossless where that is no larger than
    flate, at the original's rate where the original had a loss or was truncated."""
    few = (colors <= MAX_COLORS) | ~components.isin(1, 3, 4)
    jpx, dct = F.contains(encoding, F.lit("JPXDecode")), F.contains(encoding, F.lit("DCTDecode"))
    lossless = F.coalesce(reversible, F.lit(True)) & (original_size.isNull() | (lossless_size <= TRUNCATED_RATIO * original_size))
    tables = F.coalesce(has_tables, F.lit(False))
    return (
        F.when(bits == 1, F.lit("g4"))
        .when((bits != 8) | ~(jpx | dct) | few, F.lit("flate"))
        .when(jpx & lossless, F.when(lossless_size < flate_size, F.lit("jpx_lossless")).otherwise(F.lit("flate")))
        .when(jpx & F.coalesce(reversible, F.lit(True)), F.lit("jpx_5_3_at_rate"))
        .when(jpx, F.lit("jpx_9_7_at_rate"))
        .when(components == 4, F.when(tables, F.lit("jpeg_tables")).otherwise(F.lit("flate")))
        .otherwise(F.when(tables, F.lit("jpeg_tables")).otherwise(F.lit("jpeg_quality")))
    )


def unrotated(rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height of the visible page with its rotation undone."""
    turned = F.coalesce(rotation, F.lit(0)) % 180 != 0
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
