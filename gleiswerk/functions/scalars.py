"""Column functions: keys of trains and stations, times, sentinels, and derived values. All are built of Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Train types, longer ones before those they begin with.
TYPE_PATTERN = "^(ICE|FLX|RE|RB|IC)"


def train_id(label: Column) -> Column:
    """Upper case, blanks and hyphens as _, and _ between letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(label)), r"[\s\-]+", "_"), r"([A-Z])(\d)", "$1_$2")


def train_id_plain(label: Column) -> Column:
    """The train id without separators."""
    return F.regexp_replace(F.upper(label), r"[\s\-_]+", "")


def train_type(label: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(F.trim(label)), TYPE_PATTERN, 1), F.lit(""))


def train_number(label: Column) -> Column:
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("long")


def line_key(label: Column) -> Column:
    """Type and number without separators; null if either is missing."""
    return F.concat(train_type(label), train_number(label).cast("string"))


def station_key(name: Column) -> Column:
    """Lower case without blanks and punctuation."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s\-–—.(),&+/]", "")


def station_key_alnum(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]", "")


def station_key_folded(name: Column) -> Column:
    """Without the suffixes of main stations, umlauts folded."""
    low = F.lower(F.regexp_replace(F.trim(name), r"( Hauptbahnhof| Hbf| Pbf| \(Main\)| Bf)$", ""))
    return F.replace(F.translate(low, "üöä -", "uoa"), F.lit("ß"), F.lit("ss"))


def station_key_bare(name: Column) -> Column:
    """Without the words for main stations and airports."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"hauptbahnhof|hbf|flughafen|bahnhof", ""), r"[^\p{L}\p{N}]", "")


def station_keys(name: Column, dimension: bool = False) -> Column:
    """Keys to look a name up by, best first; the one cut at a bracket is for the dimension's side only."""
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    base = squeeze(F.lower(name))
    keys = [base, squeeze(F.replace(base, F.lit("-"), F.lit(" "))), F.replace(base, F.lit(" "), F.lit("-")), squeeze(F.translate(base, "()", "  "))]
    if dimension:
        keys.append(F.trim(F.substring_index(base, "(", 1)))
    return F.filter(F.array_distinct(F.array(*keys)), lambda x: x != "")


def minute_of_day(text: Column) -> Column:
    """'HH:MM' -> minute of the day; null beyond 23:59."""
    h, m = (F.regexp_extract(text, r"^(\d{1,2}):(\d{2})", k).try_cast("int") for k in (1, 2))
    return F.when((h < 24) & (m < 60), h * 60 + m)


def clock(minute: Column) -> Column:
    return F.concat_ws(":", F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lpad((minute % 60).cast("string"), 2, "0"))


def berlin_clock(utc: Column) -> Column:
    """A UTC time as local HH:MM."""
    return F.date_format(F.from_utc_timestamp(utc, "Europe/Berlin"), "HH:mm")


def buffer_minutes(arrival: Column, departure: Column) -> Column:
    """Minutes from arrival to departure, over midnight too."""
    return F.pmod(departure - arrival, F.lit(1440))


def light(delay: Column) -> Column:
    return F.when(delay > 15, "red").when(delay > 5, "yellow").otherwise("green")


def known_delay(text: Column, chart: bool = False) -> Column:
    """-1 is unknown; other early arrivals are 0 in charts, and null beyond 15 minutes otherwise."""
    d = text.try_cast("double")
    d = F.when(d != -1, d)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))) if chart else F.when(d >= -15, d)


def scheduled(text: Column) -> Column:
    """99:99 stands for no scheduled time."""
    return F.when(text != "99:99", text)


def message_class(text: Column) -> Column:
    """A message's category without its source, as one of four classes."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\.?\s*\(quelle:[^)]*\)", ""), r"[ .]+$", "")
    return F.when(t.startswith("bauarbeiten"), "bau").when(t.startswith("großstörung"), "gross").when(t.startswith("störung"), "stoerung").when(t.startswith("information"), "info")


def message_name(text: Column) -> Column:
    """A message's category without source and dot."""
    return F.regexp_replace(F.trim(F.substring_index(F.trim(text), "(", 1)), r"\.+$", "")


def weather_risks(snow: Column, gust: Column, precip: Column) -> dict[str, Column]:
    """The four risks of a day's weather, as flags."""
    snow, gust, precip = (F.coalesce(x.try_cast("double"), F.lit(0.0)) for x in (snow, gust, precip))
    return {"snow_risk": (snow >= 1).cast("int"), "heavy_snow_risk": (snow >= 3).cast("int"), "strong_wind_risk": (gust >= 60).cast("int"), "heavy_precip_risk": (precip >= 20).cast("int")}


def weather_delay(snow: Column, gust: Column, precip: Column) -> Column:
    """8 minutes for snow, 20 more for heavy snow, 15 for storm, 5 for heavy rain."""
    risk = weather_risks(snow, gust, precip)
    return risk["snow_risk"] * 8 + risk["heavy_snow_risk"] * 20 + risk["strong_wind_risk"] * 15 + risk["heavy_precip_risk"] * 5


def tokens(text: Column) -> Column:
    """Parts between commas and semicolons, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def importance(name: Column) -> Column:
    """How far up a station stands in a search."""
    low = F.lower(name)
    score = F.when(low.rlike("hbf|hauptbahnhof"), 10000).otherwise(0) + F.when(low.rlike("flughafen|airport"), 8000).otherwise(0)
    return score + F.greatest(F.lit(0), 30 - F.char_length(name)) * 10 + F.when(~name.contains("(") & ~F.split(name, " ")[0].contains("-"), 500).otherwise(0)


def full_train_key(kind: Column, number: Column, line: Column) -> Column:
    """Type and number; a type that isn't a known one is replaced by the line's prefix."""
    known = kind.isin("ICE", "IC", "RE", "RB", "FLX")
    return F.concat_ws("_", F.when(known, kind).otherwise(F.regexp_extract(line, r"^([A-Z]+)", 1)), number.cast("string"))
