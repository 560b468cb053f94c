"""Mixed time notations, precisions and zones to one UTC instant.

A text is split into candidate readings (day first, month first, seconds or milliseconds since 1970 ...).
Candidates without a zone are looked up, as an as-of join, in the offset intervals of their zone, laid out
in local time and exploded by year: one matching interval gives the offset, two mean an ambiguous local
time (clocks set back), none means one that never existed (clocks set forward). Of all instants found, the
latest one in `[received - window, received]` is the result.

The interval table is bounded by the number of IANA zones (about 600) times the years covered and is the
only thing broadcast. Nothing is shuffled: rows stay where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Hours ahead of UTC of the zone abbreviations understood.
ABBREVIATIONS = {
    "": 0, "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
# Month names by their first letters, in English, Italian and German.
MONTHS = {
    "JAN": 1, "GEN": 1, "FEB": 2, "MAR": 3, "MÄR": 3, "MRZ": 3, "APR": 4, "MAY": 5, "MAG": 5, "MAI": 5, "JUN": 6, "GIU": 6,
    "JUL": 7, "LUG": 7, "AUG": 8, "AGO": 8, "SEP": 9, "SET": 9, "OCT": 10, "OTT": 10, "OKT": 10, "NOV": 11, "DEC": 12, "DIC": 12, "DEZ": 12,
}

FIRST_YEAR, LAST_YEAR = 1970, 2100
DAY_US = 86_400_000_000
USUAL_STAMP = "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}[+-][0-9]{2}:[0-9]{2}$"
USUAL_EPOCH = "^[0-9]+[.][0-9]{6}$"

_ZONE = r"(?:[A-Z]{1,5}(?:[+-]\d{1,2}(?::?\d{2})?)?|[+-]\d{1,2}(?::?\d{2})?)"
_FULL = (
    r"^(\d{1,4})[-/. ]+(\d{1,2}|\p{L}{3,10})[-/. ]+(\d{1,4})"
    r"(?:(?:T|[ ,]+)(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d+))?\s*(AM|PM)?)?\s*(" + _ZONE + r")?$"
)


def _offset_at(zone: ZoneInfo, at: int) -> int:
    return int(datetime.fromtimestamp(at, timezone.utc).astimezone(zone).utcoffset().total_seconds())


def _spans(zone: ZoneInfo, year: int, standard: bool, days: int) -> list[tuple[int, int, int]]:
    """(from, to, offset) in UTC seconds over the year with so many days on either side."""
    begin = int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) - days * 86400
    end = int(datetime(year + 1, 1, 1, tzinfo=timezone.utc).timestamp()) + days * 86400
    if standard:
        middle = int(datetime(year, 7, 1, tzinfo=timezone.utc).timestamp())
        return [(begin, end, min(_offset_at(zone, begin + days * 86400), _offset_at(zone, middle)))]
    spans, at, offset = [], begin, _offset_at(zone, begin)
    for probe in range(begin + 7 * 86400, end + 7 * 86400, 7 * 86400):
        probe = min(probe, end)
        if _offset_at(zone, probe) != offset:
            low, high = probe - 7 * 86400, probe
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if _offset_at(zone, mid) == offset else (low, mid)
            spans.append((at, high, offset))
            at, offset = high, _offset_at(zone, high)
    return [*spans, (at, end, offset)]


def zone_intervals(zones: DataFrame, window_days: int = 10) -> DataFrame:
    """Of a column `zone` of IANA names: `zone, standard, year, days, spans`, the offset intervals in local microseconds, of `days` days before
    and after the year as well: the window in which instants are looked for, and two days for offsets.

    `standard` rows hold the zone's winter time all year. Unknown and null names give no rows.
    """

    days = window_days + 2

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["zone"]:
                try:
                    zone = ZoneInfo(name)
                except (KeyError, ValueError, OSError):
                    continue
                yield pd.DataFrame(
                    [
                        (name, standard, year, days, [{"lo": (a + o) * 1_000_000, "hi": (b + o) * 1_000_000, "off": o} for a, b, o in _spans(zone, year, standard, days)])
                        for standard in (False, True)
                        for year in range(FIRST_YEAR, LAST_YEAR)
                    ],
                    columns=["zone", "standard", "year", "days", "spans"],
                )

    known = zones.select("zone").where("zone is not null").distinct()
    return known.mapInPandas(lay_out, "zone string, standard boolean, year int, days int, spans array<struct<lo: bigint, hi: bigint, off: int>>")


def _map(values: dict[str, int]) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def readings(df: DataFrame, text: str) -> DataFrame:
    """`df` with `_ts_readings array<struct<us: bigint, off: int>>`, every way the text can be read as a time, `_ts_grain`, and, instead, `_ts_quick` for the usual form.

    `us` is the wall-clock time in microseconds, `off` its seconds ahead of UTC, null if the text names no zone.
    """
    number = r"^-?\d{1,20}([.,]\d{1,20})?$"
    # Names of weekdays go; a compact day gets its hyphens.
    plain = F.regexp_replace(F.upper(F.trim(F.col(text))), r"^\p{L}+\.?,?\s+(?=\d)", "")
    dashed = F.regexp_replace(plain, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    parts = F.split(F.regexp_replace(dashed, _FULL, r"$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|", -1)
    # The usual form, which most texts have, is read by position.
    piece = lambda at, n: f"cast(substring(`{text}`, {at}, {n}) as int)"
    usual_us = f"unix_micros(try_make_timestamp({piece(1, 4)}, {piece(6, 2)}, {piece(9, 2)}, {piece(12, 2)}, {piece(15, 2)}, {piece(18, 2)}, 'UTC'))"
    usual_off = f"if(substring(`{text}`, 20, 1) = '-', -60, 60) * ({piece(21, 2)} * 60 + {piece(24, 2)})"
    df = df.withColumn("_ts_quick", F.expr(f"if(length(`{text}`) = 25 and `{text}` rlike '{USUAL_STAMP}', named_struct('us', {usual_us}, 'off', {usual_off}), null)"))
    df = df.withColumn("_ts_p", F.when(F.col("_ts_quick").isNull(), parts)).withColumn("_ts_n", F.when(F.col(text).rlike(number), F.expr(f"try_cast(replace(trim(`{text}`), ',', '.') as decimal(38, 9))")))
    df = df.withColumn(
        "_ts_t",
        F.expr(
            """case when size(_ts_p) = 9 then named_struct(
                 'h', case when _ts_p[7] = '' then coalesce(try_cast(_ts_p[3] as int), 0)
                           when try_cast(_ts_p[3] as int) between 1 and 12 then try_cast(_ts_p[3] as int) % 12 + if(_ts_p[7] = 'PM', 12, 0) end,
                 'm', coalesce(try_cast(_ts_p[4] as int), 0),
                 's', coalesce(try_cast(_ts_p[5] as int), 0),
                 'f', cast(rpad(substring(_ts_p[6], 1, 6), 6, '0') as int),
                 'abbr', regexp_extract(_ts_p[8], '^[A-Z]*', 0),
                 'sign', if(_ts_p[8] like '%-%', -1, 1),
                 'zh', coalesce(try_cast(regexp_extract(_ts_p[8], '[+-]([0-9]{1,2})', 1) as int), 0),
                 'zm', coalesce(try_cast(regexp_extract(_ts_p[8], '[+-][0-9]{1,2}:?([0-9]{2})$', 1) as int), 0)) end"""
        ),
    )
    clock = "if(_ts_t.h <= 23 and _ts_t.m <= 59 and _ts_t.s <= 59, ((_ts_t.h * 60L + _ts_t.m) * 60L + _ts_t.s) * 1000000L + _ts_t.f, null)"
    offset = f"if(_ts_p[8] = '', null, try_element_at({_map(ABBREVIATIONS)}, _ts_t.abbr) * 3600 + _ts_t.sign * (_ts_t.zh * 60 + _ts_t.zm) * 60)"
    known = f"(_ts_p[8] = '' or map_contains_key({_map(ABBREVIATIONS)}, _ts_t.abbr))"
    year = lambda p: f"(cast({p} as int) + if(length({p}) <= 2, 2000, 0))"
    day = lambda y, m, d: f"unix_micros(try_make_timestamp({y}, {m}, {d}, 0, 0, 0, 'UTC'))"
    number_of = lambda p: f"try_cast({p} as int)"
    # Month lengths are checked by try_make_timestamp, which gives null for days that don't exist.
    df = df.withColumn(
        "_ts_days",
        F.expr(
            f"""case when not {known} then array(cast(null as bigint))
                 when length(_ts_p[0]) = 4 then array({day("cast(_ts_p[0] as int)", number_of("_ts_p[1]"), number_of("_ts_p[2]"))})
                 when length(_ts_p[0]) = 3 or length(_ts_p[2]) not in (2, 4) then array(cast(null as bigint))
                 when _ts_p[1] rlike '^[^0-9]' then array({day(year("_ts_p[2]"), f"try_element_at({_map(MONTHS)}, substring(_ts_p[1], 1, 3))", "cast(_ts_p[0] as int)")})
                 else array({day(year("_ts_p[2]"), number_of("_ts_p[1]"), "cast(_ts_p[0] as int)")},
                            {day(year("_ts_p[2]"), "cast(_ts_p[0] as int)", number_of("_ts_p[1]"))},
                            if(length(_ts_p[2]) = 2, {day(year("_ts_p[0]"), number_of("_ts_p[1]"), "cast(_ts_p[2] as int)")}, null)) end"""
        ),
    )
    df = df.withColumn("_ts_clock", F.expr(clock)).withColumn("_ts_off", F.expr(offset))
    df = df.withColumn("_ts_grain", F.expr("case when size(_ts_p) <> 9 then 1 when _ts_p[3] = '' then 86400 when _ts_p[4] = '' then 3600 when _ts_p[5] = '' then 60 else 1 end"))
    epochs = ", ".join(f"try_cast(floor(_ts_n * {unit}) as bigint)" for unit in ("1000000BD", "1000BD", "1BD", "0.001BD"))
    df = df.withColumn(
        "_ts_readings",
        F.expr(
            f"""if(_ts_quick is not null, array(), filter(concat(
                 if(size(_ts_p) = 9, transform(_ts_days, x -> named_struct('us', x + _ts_clock, 'off', _ts_off)), array()),
                 if(_ts_n is not null, transform(array({epochs}), x -> named_struct('us', x, 'off', 0)), array())), x -> x.us is not null))"""
        ),
    )
    return df.drop("_ts_p", "_ts_n", "_ts_t", "_ts_days", "_ts_clock", "_ts_off")


def normalise(df: DataFrame, zones: DataFrame, *, text: str, received: str, zone: str, standard: Column | None = None, window_days: int = 10, fields: tuple[str, str, str] = ("utc_us", "time_status", "grain_s")) -> DataFrame:
    """`df` with the instant of `text` in microseconds since 1970 UTC, and how it was found.

    zones: `zone_intervals`, laid out for `window_days`, of every zone that `zone` names. standard: true where the clock keeps winter time all year.
    The status is `exact`, `ambiguous` (the local time occurs twice), `nonexistent` (it was skipped), `out_of_window`
    (readable, but no reading is at most `window_days` before `received`), `unreadable` or, for a null text, null.
    `grain_s` is the unit in seconds to which the text was cut, 1 for seconds and finer.
    The instant is null for a null text and -1 without a usable reading. A null `received` leaves nothing to place a
    reading by, so it gives -1; a null or unknown zone gives -1 where the text has none of its own. Rows are
    never dropped, doubled or moved, and other columns stay as they are.
    """
    utc, status, grain = fields
    out = readings(df, text)
    keys = {"_ts_zone": F.col(zone), "_ts_standard": F.coalesce(standard, F.lit(False)) if standard is not None else F.lit(False), "_ts_year": F.year(F.col(received))}
    spans = zones.select(F.col("zone").alias("_ts_zone"), F.col("standard").alias("_ts_standard"), F.col("year").alias("_ts_year"), F.when(F.col("days") >= window_days + 2, F.col("spans")).otherwise(F.raise_error(F.lit("zone_intervals must be laid out for this window"))).alias("_ts_spans"))
    out = out.withColumns(keys).join(F.broadcast(spans), ["_ts_zone", "_ts_standard", "_ts_year"], "left")
    out = out.withColumn("_ts_got", F.unix_micros(F.col(received).cast("timestamp")))
    out = out.withColumn(
        "_ts_found",
        F.expr(
            """if(_ts_quick is not null, array(), flatten(transform(_ts_readings, r -> if(r.off is not null,
                 array(named_struct('at', r.us - r.off * 1000000L, 'n', 1)),
                 transform(filter(coalesce(_ts_spans, array()), s -> r.us >= s.lo and r.us < s.hi),
                           s -> named_struct('at', r.us - s.off * 1000000L, 'n', size(filter(_ts_spans, o -> r.us >= o.lo and r.us < o.hi))))))))"""
        ),
    )
    out = out.withColumn("_ts_at", F.expr("_ts_quick.us - _ts_quick.off * 1000000L"))
    out = out.withColumn(
        "_ts_best",
        F.expr(
            f"""if(_ts_quick is not null, if(_ts_at <= _ts_got and _ts_at >= _ts_got - {window_days} * {DAY_US}L, named_struct('at', _ts_at, 'n', 1), null),
                 array_max(filter(_ts_found, x -> x.at <= _ts_got and x.at >= _ts_got - {window_days} * {DAY_US}L)))"""
        ),
    )
    out = out.withColumns(
        {
            utc: F.expr(f"case when `{text}` is null then null else coalesce(_ts_best.at, -1L) end"),
            status: F.expr(
                f"""case when `{text}` is null then null when _ts_best.n > 1 then 'ambiguous' when _ts_best.n = 1 then 'exact'
                     when _ts_at is not null then 'out_of_window' when size(_ts_readings) = 0 then 'unreadable' when size(_ts_found) = 0 and (_ts_spans is null or exists(_ts_readings, r -> r.us >= _ts_spans[0].lo and r.us < _ts_spans[size(_ts_spans) - 1].hi)) then 'nonexistent' else 'out_of_window' end"""
            ),
        }
    )
    return out.withColumnRenamed("_ts_grain", grain).drop("_ts_quick", "_ts_at", "_ts_readings", "_ts_zone", "_ts_standard", "_ts_year", "_ts_spans", "_ts_got", "_ts_found", "_ts_best")


def usual(text: str, pattern: str = USUAL_STAMP) -> Column:
    return F.col(text).rlike(pattern)
