"""Record files whose schema drifts: ordered differences, and one consistent table.

Every record is a JSON object in a row of text, with the file it stands in and the file's place in its series. The
fields of all files are read in parallel; each file is compared with the one before it. A field that goes and one
that comes are one renamed field if they hold the same quantity for the same things, perhaps in another unit.
Types are folded through a promotion lattice, to which every file's values are cast for the union table.

What is gathered by file is its fields, not its records; pairs are built of fields that went and came in one file.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from heliovox.session import checkpointed

# Factors between units that one quantity may be given in.
UNITS = [1.0, math.pi / 180, 180 / math.pi, 1000.0, 0.001, 100.0, 0.01, 10.0, 0.1, 1e4, 1e-4, 1e6, 1e-6, 0.3048, 1 / 0.3048, 0.3048**2, 1 / 0.3048**2, 60.0, 1 / 60, 3600.0, 1 / 3600]
AGREE, CLOSE = 0.7, 1e-3
DAY_US = 86_400_000_000


def records(rows: DataFrame, *, body: str) -> DataFrame:
    """`rows` with `_v`, the record as a variant; rows that can't be read, or aren't objects, are left out."""
    parsed = rows.withColumn("_v", F.try_parse_json(body))
    return parsed.where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")


def _kind(schema: str) -> Column:
    """string, number, array, object, boolean, or null for JSON null, of a variant's schema."""
    schema = F.col(schema)
    return (
        F.when(schema == "VOID", F.lit(None)).when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
        .when(schema.like("ARRAY%"), "array").when(schema.like("OBJECT%"), "object").otherwise("number")
    )


def fields(rows: DataFrame, *, keep: list[str], body: str, thing: str) -> DataFrame:
    """A row per record and top-level field: the `keep` columns, `thing`, `name`, `kind`, `shape`, `text` and `numbers`.

    `kind` is string, number, array, object, boolean, or null for JSON null. `numbers` are all numbers in the value,
    whether written as number, text or list, with decimal point or comma.
    """
    spark = rows.sparkSession
    read = records(rows, body=body).select(*keep, F.expr(f"regexp_extract(coalesce(try_variant_get(_v, '$.{thing}', 'string'), ''), '0*([0-9]+)[^0-9]*$', 1)").alias("thing"), "_v")
    out = spark.sql("select r.*, f.key as name, f.value as _f from {read} r, lateral variant_explode(r._v) f", read=read).drop("_v")
    # What a value is, is asked once.
    out = out.withColumn("_s", F.schema_of_variant("_f")).withColumn("kind", _kind("_s"))
    out = out.withColumn("text", F.expr("case when kind in ('array', 'object') then to_json(_f) else try_cast(_f as string) end")).withColumn("shape", F.expr(shape("text", "_s")))
    # In lists a comma parts numbers, in a text by itself it is a decimal sign.
    spaced = F.when(F.col("kind").isin("array", "object"), F.regexp_replace("text", ",", " , ")).otherwise(F.col("text"))
    found = F.regexp_extract_all(F.coalesce(spaced, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])(-?[0-9]+(?:[.,][0-9]+)?(?:[eE][-+]?[0-9]+)?)"), 1)
    return out.withColumn("numbers", F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))).drop("_f", "_s")


def compared(rows: DataFrame, *, series: str, file: str, at: str, body: str) -> DataFrame:
    """`series, file, before_file, gone, came, retyped`: the fields of every file that has one before it in its series, by `at`, then `file`, against that one.

    Files are ordered within months first; of each month only the last file is gathered by series, to link the months.
    """
    parsed = F.try_parse_json(F.col(body))
    read = rows.select(F.col(series).alias("series"), F.col(file).alias("file"), F.col(at).alias("at"), parsed.alias("_v")).withColumn("_v", F.expr("if(schema_of_variant(_v) like 'OBJECT%', _v, null)"))
    # A file whose records can't be read is a file without fields.
    cells = rows.sparkSession.sql("select r.series, r.file, r.at, f.key as name, f.value as _f from {read} r, lateral variant_explode_outer(r._v) f", read=read).withColumn("_s", F.schema_of_variant("_f"))
    files = cells.groupBy("series", "file").agg(F.min("at").alias("at"), F.collect_set(F.when(F.col("name").isNotNull(), F.struct("name", _kind("_s").alias("kind")))).alias("seen"))
    # Types of values that aren't null, by name.
    typed = "transform(array_distinct(transform(seen, x -> x.name)), n -> struct(n as name, array_sort(array_compact(transform(filter(seen, x -> x.name = n), x -> x.kind))) as kinds))"
    files = files.select("series", "file", "at", F.date_trunc("month", "at").alias("month"), F.struct("file", F.expr(typed).alias("fields")).alias("own"))
    placed = files.withColumn("before", F.lag("own").over(Window.partitionBy("series", "month").orderBy("at", "file")))
    ends = files.groupBy("series", "month").agg(F.max_by("own", F.struct("at", "file")).alias("own"))
    ends = ends.select("series", "month", F.lag("own").over(Window.partitionBy("series").orderBy("month")).alias("earlier")).where("earlier is not null").withColumnsRenamed({"series": "s", "month": "m"})
    placed = placed.join(ends, placed["series"].eqNullSafe(ends["s"]) & placed["month"].eqNullSafe(ends["m"]), "left")
    both = placed.select("series", "file", "own", F.coalesce("before", "earlier").alias("before")).where("before is not null")
    names = lambda side: f"transform({side}.fields, x -> x.name)"
    # A field that is null throughout has no types, and none to change.
    other = "get(filter(before.fields, y -> y.name = x.name), 0).kinds"
    return both.select(
        "series", "file", F.col("before.file").alias("before_file"), F.expr(f"array_except({names('before')}, {names('own')})").alias("gone"), F.expr(f"array_except({names('own')}, {names('before')})").alias("came"),
        F.expr(f"transform(filter(own.fields, x -> size(x.kinds) > 0 and size({other}) > 0 and {other} <> x.kinds), x -> x.name)").alias("retyped"),
    )


def changes(rows: DataFrame, *, series: str, file: str, at: str, body: str, thing: str = "id") -> DataFrame:
    """`file, change_kind, field_name, new_name`: what changed in each file against the one before it in its series.

    Kinds are `added`, `removed`, `renamed` and `retyped`; `new_name` is '' except for renames. A file has a field if one
    of its readable records has the key, null or not; its type is that of its values that aren't null. The things that
    records describe are matched by the number at the end of field `thing`. A rename needs 70 percent of the things that
    have both values to agree within 0.1 percent, under one factor between units; without any such thing, the names
    must agree but for case and separators. Empty tables, files without readable records and null bodies give no rows;
    a file without readable records has no fields. Repeated records count once per thing.
    """
    base = rows.select(F.col(series).alias("series"), F.col(file).alias("file"), F.col(body).alias("body"))
    # One row per file, small beside its records, and used twice.
    files = checkpointed(compared(rows, series=series, file=file, at=at, body=body).where("size(gone) > 0 or size(came) > 0 or size(retyped) > 0"))
    out = _renamed(files, base, thing)
    old, new = "transform(renames, r -> r.old_name)", "transform(renames, r -> r.new_name)"
    line = lambda kind, names: f"transform({names}, n -> struct('{kind}' as change_kind, n as field_name, '' as new_name))"
    named = "transform(renames, r -> struct('renamed' as change_kind, r.old_name as field_name, r.new_name as new_name))"
    lines = F.expr(f"concat({named}, {line('removed', f'array_except(gone, {old})')}, {line('added', f'array_except(came, {new})')}, {line('retyped', 'retyped')})")
    return out.select("file", F.explode(lines).alias("l")).select("file", "l.*")


def _renamed(files: DataFrame, base: DataFrame, thing: str) -> DataFrame:
    """Rows of `compared` with `renames`, an array of `old_name, new_name, factor`: the pairs of fields that hold the same quantity.

    Only records of files that a pair concerns are opened again, and of those only the fields in question leave their row.
    """
    asked = files.where("size(gone) > 0 and size(came) > 0")
    sides = asked.select("series", F.col("file").alias("target"), F.explode(F.array(F.struct(F.col("before_file").alias("file"), F.col("gone").alias("names"), F.lit(True).alias("was")), F.struct("file", F.col("came").alias("names"), F.lit(False).alias("was")))).alias("s"))
    sides = sides.select(F.col("series").alias("s_"), "target", F.col("s.file").alias("f_"), "s.names", "s.was")
    opened = base.join(sides, base["series"].eqNullSafe(sides["s_"]) & base["file"].eqNullSafe(sides["f_"])).drop("s_", "f_", "file")
    cells = fields(opened, keep=["series", "target", "was", "names"], body="body", thing=thing)
    cells = cells.where("array_contains(names, name) and kind is not null and thing <> ''")
    values = cells.groupBy("series", "target", "was", "name", "thing").agg(F.min(F.struct("text", "numbers")).alias("x"))
    both = values.groupBy("series", "target", "thing").agg(*[F.collect_list(F.when(side, F.struct("name", "x.text", "x.numbers"))).alias(n) for n, side in (("olds", F.col("was")), ("news", ~F.col("was")))])
    met = both.select("series", "target", F.explode("olds").alias("old"), "news").select("series", "target", "old", F.explode("news").alias("new"))
    close = f"abs(b - a * u) <= {CLOSE} * greatest(abs(b), abs(a * u)) + 1e-9"
    # Zeros fit any unit, so they only speak for equality.
    fits = f"""transform({{units}}, u -> case when size(old.numbers) = 0 or size(new.numbers) = 0 then u = 1D and lower(trim(old.text)) <=> lower(trim(new.text))
               when size(old.numbers) <> size(new.numbers) then false
               else forall(zip_with(old.numbers, new.numbers, (a, b) -> {close}), ok -> ok) and (u = 1D or exists(old.numbers, a -> abs(a) > 1e-6)) end)"""
    units = "array(" + ", ".join(f"{u!r}D" for u in UNITS) + ")"
    met = met.select("series", "target", F.col("old.name").alias("old_name"), F.col("new.name").alias("new_name"), F.expr(fits.format(units=units)).alias("fits"))
    agree = F.array(*[F.count_if(F.coalesce(F.get("fits", F.lit(k)), F.lit(False))) for k in range(len(UNITS))])
    pairs = met.groupBy("series", "target", "old_name", "new_name").agg(F.count("*").alias("things"), agree.alias("agree"))
    # Of a pair's factors, those that enough things agree on; in order of how many do, no conversion first, then likeness of names.
    scored = f"""transform(filter(arrays_zip(agree, {units}), z -> z.agree >= {AGREE} * things and (z.`1` = 1D or z.agree > 1)),
                 z -> struct(-z.agree as o1, if(z.`1` = 1D, 0, 1) as o2, levenshtein(old_name, new_name) as o3, old_name, new_name, z.`1` as factor))"""
    found = pairs.select("series", "target", F.struct("old_name", "new_name").alias("pair"), F.expr(scored).alias("scored"))
    found = found.groupBy(F.col("series").alias("s_"), F.col("target").alias("t_")).agg(F.collect_list("pair").alias("met"), F.flatten(F.collect_list("scored")).alias("scored"))
    out = files.join(found, files["series"].eqNullSafe(found["s_"]) & files["file"].eqNullSafe(found["t_"]), "left").drop("s_", "t_")
    simple = lambda c: f"lower(regexp_replace({c}, '[^A-Za-z0-9]', ''))"
    unseen = f"""transform(filter(flatten(transform(gone, g -> transform(came, c -> struct(g as old_name, c as new_name)))), p -> {simple('p.old_name')} = {simple('p.new_name')} and not array_contains(coalesce(met, array()), p)),
                 p -> struct(0L as o1, 0 as o2, levenshtein(p.old_name, p.new_name) as o3, p.old_name, p.new_name, 1D as factor))"""
    out = out.withColumn("scored", F.expr(f"concat(coalesce(scored, array()), {unseen})"))
    # The best of both its names.
    best = "transform(filter(scored, c -> not exists(scored, e -> (e.old_name = c.old_name or e.new_name = c.new_name) and e < c)), c -> struct(c.old_name as old_name, c.new_name as new_name, c.factor as factor))"
    return out.withColumn("renames", F.expr(best)).drop("met", "scored")


def canonical_names(renames: list[tuple[str, str, float, int]], counts: dict[str, int]) -> dict[str, tuple[str, float]]:
    """Name -> (canonical name, factor to it) of every name that renames link; the name in most files leads.

    Works on distinct names, whose number is bounded by the width of the schemas, not by the data.
    """
    graph: dict[str, dict[str, tuple[int, float]]] = defaultdict(dict)
    for old, new, factor, n in renames:
        for a, b, f in ((old, new, factor), (new, old, 1 / factor)):
            graph[a][b] = max(graph[a].get(b, (0, 1.0)), (n, f))
    out: dict[str, tuple[str, float]] = {}
    for start in sorted(graph, key=lambda k: (-counts.get(k, 0), k)):
        if start in out:
            continue
        out[start] = (start, 1.0)
        todo = [start]
        while todo:
            a = todo.pop()
            for b, (_, f) in sorted(graph[a].items()):
                if b not in out:
                    out[b] = (start, out[a][1] / f)
                    todo.append(b)
    return out


# Forms of text that stand for something else: a whole number, a number (with a unit), a list of numbers, a day or an instant.
_NUMBER = r"[-+]?[0-9]+([.,][0-9]+)?([eE][-+]?[0-9]+)?"
_WHOLE = r"^\s*[-+]?(0|[1-9][0-9]{0,18})\s*$"
_QUANTITY = rf"^\s*{_NUMBER}\s*(°|%|[A-Za-zµ]{{1,4}}[23²³]?)?\s*$"
_LIST = rf"^\s*[\[(]?\s*{_NUMBER}([\s;]+{_NUMBER}|,\s+{_NUMBER})+\s*[\])]?\s*$"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
# The promotion lattice, each kind of value with the kinds just above it; lists are counted apart, by depth.
LATTICE = {"bigint": ["double"], "double": ["string"], "boolean": ["string"], "timestamp": ["string"], "numbers": ["double"], "object": ["string"], "string": []}
_NUMERIC = {"bigint", "double", "numbers"}


def above(kind: str) -> set[str]:
    return {kind}.union(*map(above, LATTICE[kind]))


def shape(text: str, schema: str) -> str:
    """SQL for the shape of a variant of this schema: the kind of its innermost values, with a `[]` for every list around them. `text` is the variant as text.

    Text counts as what it says as a whole: a number, alone or with a unit, a list of numbers, a day or an instant. `numbers` is an
    object of numbers.
    """
    said = f"""case when {text} rlike r'{_WHOLE}' and try_cast(trim({text}) as bigint) is not null then 'bigint' when {text} rlike r'^\\s*[-+]?[0-9]+\\s*$' then 'string' when {text} rlike r'{_QUANTITY}' then 'double' when {text} rlike r'{_LIST}' then 'double[]'
        when {text} rlike r'{_STAMP}' and try_to_timestamp({text}) is not null then 'timestamp' else 'string' end"""
    kind = f"regexp_replace({schema}, 'ARRAY<|>+$', '')"
    lists = f"repeat('[]', (length({schema}) - length(replace({schema}, 'ARRAY<', ''))) div 6)"
    named = f"""case when {kind} = 'BIGINT' then 'bigint' when {kind} rlike '^(DECIMAL|DOUBLE|FLOAT)' then 'double' when {kind} = 'BOOLEAN' then 'boolean' when {kind} = 'STRING' then 'string' when {kind} = 'VOID' then 'void' end"""
    return f"""case when {schema} is null or {schema} = 'VOID' then null when {schema} = 'STRING' then {said} when {schema} = 'BIGINT' then 'bigint' when {schema} = 'BOOLEAN' then 'boolean'
        when {schema} rlike '^(DECIMAL|DOUBLE|FLOAT)' then 'double'
        when {schema} like 'OBJECT%' then if({schema} rlike '^OBJECT<([^:,<>]+: (BIGINT|DOUBLE|FLOAT|DECIMAL.[0-9]+,[0-9]+.)(, )?)+>$', 'numbers', 'object')
        when {schema} like 'ARRAY%' then coalesce(concat({named}, {lists}), 'object[]') else 'string' end"""


def promote(shapes: set[str]) -> str:
    """The least type to which values of all these shapes can be cast without loss.

    Numbers in lists of different depth go to the deepest, a value standing for a list of one; an object of numbers goes with lists of numbers.
    Objects, and what has nothing else in common, are text, as JSON.
    """
    parts = {(x.replace("[]", ""), x.count("[]")) for x in shapes}
    if any(k == "void" for k, _ in parts):  # empty lists fit any list
        depth = max(d for k, d in parts if k == "void")
        parts = {(k, max(d, depth)) for k, d in parts if k != "void"} or {("string", depth)}
    kinds = {k for k, _ in parts}
    if kinds == {"numbers"}:
        return "string"
    if kinds <= _NUMERIC:
        depth = max(max(d, int(k == "numbers")) for k, d in parts)
        kind = "bigint" if kinds == {"bigint"} else "double"
    else:
        common = set.intersection(*map(above, kinds)) if kinds else {"string"}
        kind = min(common, key=lambda t: -len(above(t)))
        depth = max(d for _, d in parts) if len({d for _, d in parts}) == 1 and len(kinds) == 1 else 0
        if kind == "object":
            kind, depth = "string", 0
    return "array<" * depth + kind + ">" * depth


def cast(value: str, wanted: str, factor: float = 1.0) -> str:
    """SQL for a variant as the type that `promote` gave, numbers times `factor`; null where the value is null."""
    got, text = lambda t: f"try_variant_get({value}, '$', '{t}')", f"try_variant_get({value}, '$', 'string')"
    kind, depth = wanted.replace("array<", "").rstrip(">"), wanted.count("array<")
    if kind in ("bigint", "double"):
        number = f"try_cast(replace(regexp_extract({text}, r'({_NUMBER})', 1), ',', '.') as double)" if kind == "double" else f"try_cast(trim({text}) as bigint)"
        levels = [f"if(schema_of_variant({value}) = 'STRING', if({text} rlike r'{_LIST}', null, {number}), {got(kind)})"]
        if depth:
            listed = f"transform(regexp_extract_all({text}, r'({_NUMBER})', 1), x -> try_cast(replace(x, ',', '.') as {kind}))"
            spoken = f"if(schema_of_variant({value}) = 'STRING' and {text} rlike r'{_LIST}', {listed}, null)"
            levels.append(f"coalesce({got(f'array<{kind}>')}, map_values({got(f'map<string,{kind}>')}), {spoken})")
        levels += [got("array<" * d + kind + ">" * d) for d in range(2, depth + 1)]
        # A value of less depth stands for a list of one.
        parts = []
        for d, level in reversed(list(enumerate(levels))):
            scaled = level
            if factor != 1.0:
                scaled = "x0"
                for k in range(1, d + 1):
                    scaled = f"transform(x{k}, x{k - 1} -> {scaled})" if k > 1 else f"transform(x{k}, x0 -> x0 * {factor!r}D)"
                scaled = f"transform(array({level}), x{d} -> {scaled if d else f'x0 * {factor!r}D'})[0]"
            for _ in range(depth - d):
                scaled = f"if({scaled} is null, null, array({scaled}))"
            parts.append(scaled)
        return f"coalesce({', '.join(parts)})"
    if depth:
        return got(wanted)
    if kind == "timestamp":
        return f"try_to_timestamp({text})"
    if kind == "boolean":
        return got("boolean")
    return f"if(schema_of_variant({value}) rlike '^(ARRAY|OBJECT)', to_json({value}), {text})"


def union_table(rows: DataFrame, *, series: str, file: str, at: str, body: str, keep: list[str], thing: str = "id") -> DataFrame:
    """Every readable record of all files in one schema: `series`, `file`, `keep`, and a column per canonical field.

    Renamed fields go under the name that most files use, values in other units are converted, and each column has the
    least type that all of its files' values can be cast to without loss: whole numbers stay whole, texts that aren't numbers
    as a whole stay text, lists keep their depth. Records that can't be read are left out; a field that a
    record doesn't have is null; names may hold any character. The only things collected are field names with their shapes and renames.
    """
    base = rows.select(F.col(series).alias("series"), F.col(file).alias("file"), F.col(body).alias("body"))
    cells = fields(base, keep=["series", "file"], body="body", thing=thing)
    files = checkpointed(compared(rows, series=series, file=file, at=at, body=body).where("size(gone) > 0 and size(came) > 0"))
    pairs = _renamed(files, base, thing).select(F.explode("renames").alias("r")).groupBy("r.old_name", "r.new_name", "r.factor").count()
    renames = [tuple(r) for r in pairs.collect()]
    seen = cells.where("kind is not null").groupBy("name", "shape").agg(F.count("*").alias("n")).collect()
    counts: dict[str, int] = defaultdict(int)
    for r in seen:
        counts[r["name"]] += r["n"]
    names = canonical_names(renames, counts)
    shapes: dict[str, set[str]] = defaultdict(set)
    members: dict[str, dict[str, float]] = defaultdict(dict)
    for r in seen:
        lead, factor = names.get(r["name"], (r["name"], 1.0))
        # Whole numbers in another unit need not stay whole.
        shapes[lead].add(r["shape"].replace("bigint", "double") if factor != 1.0 else r["shape"])
        members[lead][r["name"]] = factor
    # Fields are looked up by name, whatever characters it holds, and each is read once.
    every = sorted({n for m in members.values() for n in m})
    place = {n: f"_f{k}" for k, n in enumerate(every)}
    out = records(rows, body=body).withColumn("_m", F.expr("try_cast(_v as map<string, variant>)"))
    out = out.select(series, file, *keep, *[F.try_element_at("_m", F.lit(n)).alias(place[n]) for n in every])
    columns = [F.expr(f"coalesce({', '.join(cast(place[n], promote(shapes[lead]), f) for n, f in sorted(m.items()))})").alias(lead) for lead, m in sorted(members.items())]
    return out.select(series, file, *keep, *columns)
