"""SQL that compares the schemas of record files by joins of their fields, file by file."""

from __future__ import annotations

from heliovox.operators.schema_drift import AGREE, CLOSE, UNITS

_NUMBERS = r"(?:^|[^A-Za-z0-9_])(-?[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?)"
_UNITS = "[" + ", ".join(f"{u!r}::double" for u in UNITS) + "]"
_SIMPLE = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"


def changes(source: str, thing: str, file_name: str) -> str:
    """Of `source(s, f, t, b)`, series, file, time and record: the changes of each file, its number under `file_name`."""
    return f"""with r as {source}, w as (select s, f, lag(f) over u p, lag(1) over u had from (select s, f, min(t) t from r group by 1, 2) window u as (partition by s order by t nulls first, f)),
    k as (select s, f, b, unnest(json_keys(b)) n from r where json_valid(b) and json_type(b) = 'OBJECT'),
    v as (select s, f, n, json_type(b, '$."' || n || '"') jt, json_extract(b, '$."' || n || '"') x, json_extract_string(b, '$."' || n || '"') t, regexp_extract(coalesce(json_extract_string(b, '$.{thing}'), ''), '0*([0-9]+)[^0-9]*$', 1) thing from k),
    y as (select *, case when jt = 'VARCHAR' then 'string' when jt in ('BOOLEAN', 'ARRAY', 'OBJECT') then lower(jt) when jt <> 'NULL' then 'number' end kind from v),
    i as (select s, f, n, coalesce(list_sort(list(distinct kind) filter (kind is not null)), []) ks from y group by 1, 2, 3),
    b0 as (select w.s, w.f, w.p, i.n, i.ks from w join i on w.s = i.s and w.p = i.f where had = 1), a0 as (select w.s, w.f, w.p, i.n, i.ks from w join i on w.s = i.s and w.f = i.f where had = 1),
    c as (select coalesce(b0.s, a0.s) s, coalesce(b0.f, a0.f) f, coalesce(b0.p, a0.p) p, coalesce(b0.n, a0.n) n, b0.ks bk, a0.ks ak, b0.n is null came, a0.n is null gone from b0 full join a0 on b0.s = a0.s and b0.f = a0.f and b0.n = a0.n),
    q as (select g.s, g.f, g.p, g.n o, h.n n from c g join c h on g.s = h.s and g.f = h.f where g.gone and h.came),
    e as (select s, f, n, thing, min(t) t, arg_min(list_transform(regexp_extract_all(case when jt in ('ARRAY', 'OBJECT') then regexp_replace(x::varchar, ',', ' , ', 'g') else t end, '{_NUMBERS}', 1), lambda z: try_cast(replace(z, ',', '.') as double)), t) m
      from y where kind is not null and thing <> '' group by 1, 2, 3, 4),
    j as (select q.s, q.f, q.o, q.n, case when len(a.m) = 0 or len(b.m) = 0 then case when lower(trim(a.t)) = lower(trim(b.t)) then [1.0::double] else [] end when len(a.m) <> len(b.m) then []
        else list_filter({_UNITS}, lambda u: len(list_filter(list_zip(a.m, b.m), lambda z: abs(z[2] - z[1] * u) <= {CLOSE} * greatest(abs(z[2]), abs(z[1] * u)) + 1e-9)) = len(a.m) and (u = 1 or len(list_filter(a.m, lambda z: abs(z) > 1e-6)) > 0)) end fits
      from q join e a on q.s = a.s and q.p = a.f and q.o = a.n join e b on q.s = b.s and q.f = b.f and q.n = b.n and a.thing = b.thing),
    met as (select s, f, o, n, count(*) things from j group by 1, 2, 3, 4), fit as (select s, f, o, n, u, count(*) agree from (select s, f, o, n, unnest(fits) u from j) group by 1, 2, 3, 4, 5),
    sc as (select s, f, o, n, u, agree from fit join met using (s, f, o, n) where agree >= {AGREE} * things and (u = 1 or agree > 1)
      union all select s, f, o, n, 1.0, 0 from q anti join met using (s, f, o, n) where {_SIMPLE.format('o')} = {_SIMPLE.format('n')}),
    rk as (select *, row_number() over (partition by s, f, o order by agree desc, (u <> 1)::int, levenshtein(o, n), o, n, u) x, row_number() over (partition by s, f, n order by agree desc, (u <> 1)::int, levenshtein(o, n), o, n, u) z from sc),
    rn as (select s, f, o, n from rk where x = 1 and z = 1)
    select f as {file_name}, 'renamed' as change_kind, o as field_name, n as new_name from rn
    union all select f, 'removed', n, '' from c where gone and not exists (select 1 from rn where rn.s = c.s and rn.f = c.f and rn.o = c.n)
    union all select f, 'added', n, '' from c where came and not exists (select 1 from rn where rn.s = c.s and rn.f = c.f and rn.n = c.n)
    union all select f, 'retyped', n, '' from c where not gone and not came and len(bk) > 0 and len(ak) > 0 and bk <> ak"""


FOUND = changes("(select series_id s, file_id f, exported_at t, body b from plane_records)", "id", "file_id")
_ROW = "to_json({{'_plane': printf('%d%09d', series_id, id), {own}}})"
_FIELDS = "'id': id, 'normal': normal, 'd': d, 'inlier_count': inlier_count, 'centroid_3d': centroid_3d, 'width_m': width_m, 'height_m': height_m, 'area_m2': area_m2, 'angle_deg': angle_deg, 'center_3d': center_3d, 'corners_3d': corners_3d, 'basis_u': basis_u, 'basis_v': basis_v"
TABLES = changes(
    f"(select 0 s, 'planes_notilt' f, 0 t, {_ROW.format(own=_FIELDS)}::varchar b from planes_notilt union all select 0, 'planes', 1, {_ROW.format(own=_FIELDS + ', ' + repr('orientation') + ': orientation, ' + repr('tilt_deg') + ': tilt_deg')}::varchar from planes)", "_plane", "table_name"
)
