"""Keys, lift names and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Client lift names and model codes.
NO_NUMBER = 10**9
LIFT_CODES = {"Bench Press": 0, "Squat": 1, "Deadlift": 2}
CLIENT_LIFTS = {"squat": "Squat", "bench press": "Bench Press", "bench": "Bench Press", "deadlift": "Deadlift"}
DISPLAY_LIFTS = {"squat": "Squat", "bench": "Bench Press", "deadlift": "Deadlift"}
UNKNOWN_LIFT_CODE = 3
DEFAULT_MOVEMENT_CODE = 1


def file_stem(name: Column) -> Column:
    """File name without its last extension, trimmed; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(name, r"(?<=[^./])\.[^./]*$", "")), F.lit(""))


def first_number(name: Column) -> Column:
    """First run of digits, else a value that sorts last."""
    digits = F.regexp_extract(name, r"\d+", 0)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(NO_NUMBER))


def lift_code(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("bench"), 0)
        .when(low.contains("squat"), 1)
        .when(low.contains("dead"), 2)
        .otherwise(UNKNOWN_LIFT_CODE)
    )


def movement_from_name(name: Column) -> Column:
    """Movement named in a file name; null where none is."""
    low = F.lower(name)
    return (
        F.when(low.contains("bench"), "Bench Press")
        .when(low.contains("squat"), "Squat")
        .when(low.contains("deadlift"), "Deadlift")
    )


def movement(given: Column, name: Column) -> Column:
    """Given movement in title case, else from the file name; null if not one
    of the three lifts."""
    chosen = F.initcap(F.trim(F.coalesce(given, movement_from_name(name))))
    return F.when(chosen.isin(*LIFT_CODES), chosen)


def movement_code(name: Column) -> Column:
    codes = F.create_map(*[F.lit(v) for pair in LIFT_CODES.items() for v in pair])
    return F.coalesce(F.try_element_at(codes, name), F.lit(DEFAULT_MOVEMENT_CODE))


def exercise(video_name: Column) -> Column:
    """Keyword match, else all words but the last, else 'unknown'."""
    low = F.lower(video_name)
    words = F.split(F.trim(video_name), r"\s+")
    return (
        F.when(low.contains("squat"), "squat")
        .when(low.contains("deadlift"), "deadlift")
        .when(low.contains("bench"), "bench_press")
        .when(F.size(words) >= 2, F.lower(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")))
        .otherwise("unknown")
    )


def _named(name: Column, names: dict[str, str], fallback: Column) -> Column:
    out = None
    for key, shown in names.items():
        hit = F.lower(name) == key
        out = F.when(hit, shown) if out is None else out.when(hit, shown)
    return out.otherwise(fallback)


def client_lift(name: Column) -> Column:
    """Request lift name to the model's; null where unknown."""
    return _named(name, CLIENT_LIFTS, F.lit(None).cast("string"))


def display_lift(name: Column) -> Column:
    return _named(name, DISPLAY_LIFTS, name)


def with_extension(name: Column, extension: str = ".mp4") -> Column:
    return F.when(name.endswith(extension), name).otherwise(F.concat(name, F.lit(extension)))


def filled_video_name(video_name: Column, set_id: Column) -> Column:
    return F.coalesce(video_name, F.concat(set_id, F.lit(".mp4")))


def history_id(at: Column, name: Column) -> Column:
    """Epoch seconds and file name."""
    return F.concat((F.unix_micros(at) / 1e6).cast("decimal(20,6)").cast("string"), F.lit("_"), name)
