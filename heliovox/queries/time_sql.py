"""SQL that reads time texts by another way than the operator: zones by DuckDB's own conversion, checked by converting back."""

from __future__ import annotations

from heliovox.operators.timestamps import ABBREVIATIONS, MONTHS, USUAL_EPOCH, USUAL_STAMP

_PATTERN = r"^(\d{1,4})[-/. ]+(\d{1,2}|\pL{3,10})[-/. ]+(\d{1,4})(?:(?:T|[ ,]+)(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d+))?\s*(AM|PM)?)?\s*([A-Z]{1,5}(?:[+-]\d{1,2}(?::?\d{2})?)?|[+-]\d{1,2}(?::?\d{2})?)?$"
_MAP = lambda values: "map {" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"
_US = lambda day: f"epoch_us(try_cast({day} as timestamp))"
_DAY = lambda y, m, d: f"lpad(({y})::varchar, 4, '0') || '-' || lpad(({m})::varchar, 2, '0') || '-' || lpad(({d})::varchar, 2, '0')"


def instants(name: str, source: str) -> str:
    """CTEs that end in `name(id, utc_us)`: of `source(id, x, got, tz, std, usual)`, the latest reading in the ten days before `got`, or -1.

    `x` is the text, not null, `tz` its zone if it names none, `std` whether that zone's clock keeps winter time.
    """
    year = lambda p: f"(try_cast({p} as int) + case when length({p}) <= 2 then 2000 else 0 end)"
    return f"""
{name}_a as (select *, regexp_replace(regexp_replace(upper(trim(x)), '^\\pL+\\.?,?\\s+(\\d)', '\\1'), '^(\\d{{4}})(\\d{{2}})(\\d{{2}})(T|$)', '\\1-\\2-\\3\\4') u from {source}),
{name}_b as (select *, regexp_extract(u, '{_PATTERN}', ['a', 'b', 'c', 'h', 'm', 's', 'f', 'ap', 'z']) p, regexp_full_match(u, '{_PATTERN}') hit,
    case when regexp_full_match(x, '\\s*-?\\d{{1,20}}([.,]\\d{{1,20}})?\\s*') then try_cast(replace(trim(x), ',', '.') as decimal(38, 9)) end v from {name}_a),
{name}_c as (select *, case when p.ap = '' then coalesce(try_cast(p.h as int), 0) when try_cast(p.h as int) between 1 and 12 then try_cast(p.h as int) % 12 + case p.ap when 'PM' then 12 else 0 end end hh,
    coalesce(try_cast(p.m as int), 0) mm, coalesce(try_cast(p.s as int), 0) ss, cast(rpad(substring(p.f, 1, 6), 6, '0') as int) ff,
    case when p.z = '' then null else {_MAP(ABBREVIATIONS)}[regexp_extract(p.z, '^[A-Z]*')] * 3600 + case when p.z like '%-%' then -1 else 1 end
      * (coalesce(try_cast(regexp_extract(p.z, '[+-](\\d{{1,2}})', 1) as int), 0) * 3600 + coalesce(try_cast(regexp_extract(p.z, '[+-]\\d{{1,2}}:?(\\d{{2}})$', 1) as int), 0) * 60) end zone_s from {name}_b),
{name}_d as (select *, case when not hit or hh > 23 or mm > 59 or ss > 59 or hh is null or (p.z <> '' and zone_s is null) then []
    when length(p.a) = 4 then [{_US(_DAY("p.a", "p.b", "p.c"))}]
    when length(p.a) = 3 or length(p.c) not in (2, 4) then []
    when regexp_matches(p.b, '^\\pL') then [{_US(_DAY(year("p.c"), f"{_MAP(MONTHS)}[substring(p.b, 1, 3)]", "p.a"))}]
    else [{_US(_DAY(year("p.c"), "p.b", "p.a"))}, {_US(_DAY(year("p.c"), "p.a", "p.b"))}, case when length(p.c) = 2 then {_US(_DAY(year("p.a"), "p.b", "p.c"))} end] end as ds from {name}_c),
{name}_e as (select id, got, tz, std, zone_s, d0 + ((hh * 60 + mm) * 60 + ss) * 1000000::bigint + ff w from (select * exclude (ds), unnest(ds) as d0 from {name}_d) where d0 is not null),
{name}_f as (
  select id, got, w - zone_s * 1000000::bigint t from {name}_e where zone_s is not null
  union all select id, got, t from (select id, got, tz, w, unnest([b - 7200000000, b - 3600000000, b, b + 3600000000, b + 7200000000]) t from (select *, epoch_us(timezone(tz, make_timestamp(w))) b from {name}_e where zone_s is null and not std))
    where epoch_us(timezone(tz, make_timestamptz(t))) = w
  union all select id, got, w - least(w0 - epoch_us(timezone(tz, make_timestamp(w0))), w6 - epoch_us(timezone(tz, make_timestamp(w6)))) t from (select *, epoch_us(date_trunc('year', make_timestamp(w))) w0, epoch_us(date_trunc('year', make_timestamp(w)) + interval 6 months) w6 from {name}_e where zone_s is null and std)
  union all select id, got, unnest([try_cast(floor(v * 1000000) as bigint), try_cast(floor(v * 1000) as bigint), try_cast(floor(v) as bigint), try_cast(try_cast(floor(v) as hugeint) // 1000 as bigint)]) t from {name}_d where v is not null),
{name}_g as (select id, max(t) t from {name}_f where t <= epoch_us(got) and t >= epoch_us(got) - 864000000000 group by 1),
{name} as (select s.id, coalesce(g.t, -1) utc_us from {source} s left join {name}_g g using (id))"""


def _rows(table: str, key: str, text: str, got: str, zone: str, std: str, usual: str, join: str = "", only: bool = True) -> str:
    rest = f" and not regexp_matches({text}, '{usual}')" if only else ""
    return f"(select {key} id, {text} x, {got} got, {zone} tz, {std} std from {table} {join} where {text} is not null{rest})"


_LOGGER = "left join loggers using (logger_id) left join stations st on st.station_id = loggers.station_id"
P2 = "with " + ",".join(
    f"s{n} as {_rows(*args)}, {instants(f'i{n}', f's{n}')}"
    for n, args in enumerate(
        (
            ("legnaro_ghi", "reading_id", "timestamp", "received_at", "tz_name", "coalesce(clock = 'standard', false)", USUAL_STAMP, _LOGGER),
            ("plane3_capture_window_perez", "row_id", "timestamp", "computed_at", "'Europe/Rome'", "false", USUAL_STAMP),
            ("lidar_depth_assoc_manifest", "row_id", "zed_epoch", "written_at", "'Europe/Rome'", "false", USUAL_EPOCH),
        )
    )
) + " select 'legnaro_ghi' table_name, id row_id, utc_us from i0 union all select 'plane3_capture_window_perez', id, utc_us from i1 union all select 'lidar_depth_assoc_manifest', id, utc_us from i2"

P3 = f"""with s as {_rows("legnaro_ghi", "reading_id", "timestamp", "received_at", "tz_name", "coalesce(clock = 'standard', false)", USUAL_STAMP, _LOGGER, only=False)}, {instants("i", "s")},
r as (select g.logger_id, l.step_s * 1000000::bigint step, utc_us // (l.step_s * 1000000::bigint) k from i join legnaro_ghi g on g.reading_id = i.id join loggers l on l.logger_id = g.logger_id where utc_us >= 0 and ghi is not null),
b as (select logger_id, step, min(k) lo, max(k) hi from r group by 1, 2), e as (select logger_id, step, unnest(range(lo, hi + 1)) k from b)
select logger_id, k * step as slot_us from e anti join r using (logger_id, step, k)"""

P3_MEANS = f"""with s as {_rows("legnaro_ghi", "reading_id", "timestamp", "received_at", "tz_name", "coalesce(clock = 'standard', false)", USUAL_STAMP, _LOGGER, only=False)}, {instants("i", "s")},
r as (select g.logger_id, l.step_s * 1000000::bigint step, utc_us t, ghi v from i join legnaro_ghi g on g.reading_id = i.id join loggers l on l.logger_id = g.logger_id where utc_us >= 0 and ghi is not null),
o as (select *, t // step k, least(t + step, coalesce(lead(t) over (partition by logger_id order by t, v), t + step)) e from r), c as (select *, unnest([k, k + 1]) cell from o),
h as (select *, greatest(0, least(e, (cell + 1) * step) - greatest(t, cell * step)) held from c), b as (select logger_id, max(k) hi from o group by 1)
select logger_id, cell * step as slot_us, cast(sum((cell = k)::int) as bigint) n_readings, round(sum(v * held) / sum(held), 8) as "mean", round(sum(held) / any_value(step), 8) coverage
from h join b using (logger_id) where cell <= hi group by logger_id, cell, step having sum(held) > 0"""

P3_GRID = f"""with m as ({P3_MEANS}), f as ({P3}) select logger_id, slot_us, n_readings, "mean", coverage, case when n_readings > 0 then 'observed' else 'held' end status from m
union all select logger_id, slot_us, 0, null, 0.0, 'empty' from f anti join m using (logger_id, slot_us)"""
