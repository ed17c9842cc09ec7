"""Problem 3: schemas that drift between files.

Each object of an assistant line that the schema describes is compared with it by
itself. Where an object both lacks required fields and has unknown ones, the layout
(object, fields lost, fields gained) is a version of the schema. Its unknown columns are
profiled over all lines of that version: JSON type, a sketch of the values (a histogram
over magnitude or shape classes) and the name. Against the profiles of the lost columns,
taken from all sound lines, a maximum bipartite matching of greatest similarity tells
which unknown column is the new name of which lost one. Then every file's columns are
unified under the schema's names.

Versions are matched with the schema, not with one another: a rename is to a name the
schema doesn't know, and a pair of the right type counts however little the names and
values are alike, as the schema says that no line loses one field and gains an unrelated
one of its type. Similarity decides which is which where more is lost than gained.

Only aggregates meet: lines are reduced to their layouts, counted per file within each
task first, and a sketch has at most ``CLASSES`` classes of texts and as many of objects,
64 of numbers and two of truth values.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, ship

_OBJECT = "map<string,variant>"
#: Into how many classes a sketch sorts the texts of a column, and the objects.
CLASSES = 256
_SCOPE = ("type", "message.model", "message.usage")


@dataclass
class SchemaObject:
    """An object of the schema: its dotted path ('' for the line) and its fields with type, duty and whether changes to them are reported."""

    path: str
    fields: dict[str, tuple[str, bool, bool]] = field(default_factory=dict)

    @property
    def json_path(self) -> str:
        return "$" + "".join(f".{p}" for p in self.path.split(".") if p)


def schema_objects(log_schema: DataFrame) -> list[SchemaObject]:
    """The objects of ``log_schema``; it is a fixed description of some dozen fields, so it comes to the driver."""
    rows = [r for r in log_schema.where("field IS NOT NULL").distinct().collect()]
    objects = {"": SchemaObject("")} | {r.field: SchemaObject(r.field) for r in rows if r.json_type == "object"}
    for r in rows:
        parent, _, name = r.field.rpartition(".")
        if parent in objects:
            within = any(r.field == s or r.field.startswith(s + ".") for s in _SCOPE)
            objects[parent].fields[name] = (r.json_type, bool(r.is_required), within)
    return [objects[k] for k in sorted(objects) if objects[k].fields]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(s: str) -> str:
    """SQL: the JSON type for the result of ``schema_of_variant``. Numbers written with a fraction or an exponent aren't integers; digits beyond 64 bits are."""
    return (
        f"CASE WHEN {s} = 'BIGINT' THEN 'integer' WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} = 'VOID' THEN 'null' "
        f"WHEN startswith({s}, 'OBJECT<') THEN 'object' WHEN startswith({s}, 'ARRAY<') THEN 'array' "
        f"WHEN {s} RLIKE '^DECIMAL[(](19|[23][0-9]),0[)]$' THEN 'integer' ELSE 'number' END"
    )


def _sketch_class(x: str, kind: str) -> str:
    """SQL: the class of a value in the sketch of its column: magnitude, or a hash of length and first characters, or of the keys."""
    s = f"CAST({x} AS string)"
    head = f"translate(lower(substr({s}, 1, 3)), '0123456789abcdefghijklmnopqrstuvwxyz', '9999999999aaaaaaaaaaaaaaaaaaaaaaaaaa')"
    return (
        f"CASE {kind} WHEN 'integer' THEN concat('i', CAST(floor(log2(abs(CAST({x} AS double)) + 1)) AS string)) "
        f"WHEN 'string' THEN concat('s', pmod(xxhash64(CAST(floor(log2(length({s}) + 1)) AS string), {head}), {CLASSES})) WHEN 'boolean' THEN concat('b', {s}) "
        f"WHEN 'object' THEN concat('o', pmod(xxhash64(array_join(array_sort(map_keys(try_cast({x} AS {_OBJECT}))), ',')), {CLASSES})) ELSE 'x' END"
    )


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient over the character pairs of the two names' words, spelling style apart."""
    words = lambda s: re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s).lower())
    pairs = lambda s: {w[i : i + 2] for w in words(s) for i in range(max(1, len(w) - 1))}
    x, y = pairs(a), pairs(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def sketch_similarity(a: dict[str, int], b: dict[str, int]) -> float:
    """Overlap of two histograms, each scaled to one."""
    n, m = sum(a.values()), sum(b.values())
    return sum(min(v / n, b.get(k, 0) / m) for k, v in a.items()) if n and m else 0.0


def best_matching(score: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching (shortest augmenting paths with potentials); a negative score is no edge.

    The matching has as many pairs as possible and, among those, the greatest sum.
    """
    rows, cols = len(score), max((len(r) for r in score), default=0)
    if not rows or not cols:
        return []
    n = max(rows, cols)
    worst = 10.0 * n
    cost = [[worst - (worst + score[i][j]) * (score[i][j] >= 0) if i < rows and j < cols else worst for j in range(n)] for i in range(n)]
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [math.inf] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while True:
            used[j0], i0, delta, j1 = True, match[j0], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, cols + 1) if match[j] <= rows and score[match[j] - 1][j - 1] >= 0]


class Drift:
    """The changes of each file against ``log_schema``, and the lines unified under it.

    Lines are those of parsable objects whose ``message.role`` is 'assistant'; a null
    ``src`` is a file of its own. Blank, broken and other lines play no part.
    """

    def __init__(self, spark: SparkSession, call_log: DataFrame, log_schema: DataFrame):
        ship(spark)
        self.spark, self.objects = spark, schema_objects(log_schema)
        self.scratch = Scratch(spark, "drift")
        # Only a line that spells 'assistant', plainly or with escapes, can have that role; the others aren't parsed.
        likely = call_log.where("contains(json, 'assistant') OR contains(json, '\\\\u')")
        parsed = likely.selectExpr("log_id", "src", "try_parse_json(json) AS v")
        self.lines = parsed.where("try_variant_get(v, '$.message.role', 'string') = 'assistant'")
        self._profiled()

    def _object(self, o: SchemaObject) -> str:
        """SQL: an array of one struct (object, lost, gained, retyped, profile), or of none where the line hasn't the object.

        ``gained`` has name, kind and sketch class, ``profile`` name and class of the required fields.
        """
        m = f"try_cast(v AS {_OBJECT})" if not o.path else f"try_variant_get(v, '{o.json_path}', '{_OBJECT}')"
        required = [k for k, (_, duty, _) in o.fields.items() if duty]
        kinds = {k: t for k, (t, _, within) in o.fields.items() if within and t != "any"}
        unread = [k for k in o.fields if k not in required and k not in kinds]
        listed = lambda names: ", ".join(map(_quoted, names)) or "''"
        entries = f"transform(map_entries(map_filter(m, (k, x) -> k NOT IN ({listed(unread)}))), e -> struct(e.key AS name, e.value AS x, schema_of_variant(e.value) AS s))"
        read = f"transform({entries}, e -> struct(e.name AS name, e.x AS x, {_kind('e.s')} AS kind))"
        classed = f"transform({read}, e -> struct(e.name AS name, e.kind AS kind, {_sketch_class('e.x', 'e.kind')} AS class))"
        wanted = f"map({', '.join(f'{_quoted(k)}, {_quoted(t)}' for k, t in kinds.items())})" if kinds else "CAST(map() AS map<string,string>)"
        body = (
            f"transform(transform(filter(array({m}), m -> m IS NOT NULL), m -> {classed}), c -> struct({_quoted(o.path)} AS object, "
            f"sort_array(array_except(array({listed(required)}), transform(c, e -> e.name))) AS lost, "
            f"array_sort(filter(c, e -> e.name NOT IN ({listed(o.fields)}))) AS gained, "
            f"sort_array(transform(filter(c, e -> e.name IN ({listed(kinds)}) AND e.kind NOT IN ('null', element_at({wanted}, e.name))), e -> e.name)) AS retyped, "
            f"transform(filter(c, e -> e.name IN ({listed(required)})), e -> struct(e.name AS name, e.class AS class)) AS profile))"
        )
        return body

    def _compared(self, *keys: str) -> DataFrame:
        """``keys`` and a row per object of each line; the line is parsed once for all of them."""
        return self.lines.selectExpr(*keys, f"inline(concat({', '.join(self._object(o) for o in self.objects)}))")

    def _profiled(self) -> None:
        """Layouts per file and value sketches per version, both from one pass over the lines.

        A line gives a cell for its layout, which alone carries the file, and one for
        each column to be profiled; the cells are counted within each task first.
        """
        rows = self._compared("src").withColumn("new", F.expr("transform(gained, g -> struct(g.name AS name, g.kind AS kind))"))
        cell = lambda side, src, lost, new, retyped, name, cls: f"struct({side} AS side, {src} AS src, {lost} AS lost, {new} AS new, {retyped} AS retyped, {name} AS name, {cls} AS class)"
        no_text, no_new = "CAST(NULL AS array<string>)", "CAST(NULL AS array<struct<name:string,kind:string>>)"
        whole = f"filter(array({cell("'layout'", 'src', 'lost', 'new', 'retyped', 'CAST(NULL AS string)', 'CAST(NULL AS string)')}), x -> size(lost) + size(new) + size(retyped) > 0)"
        fresh = f"CASE WHEN size(lost) > 0 THEN transform(gained, g -> {cell("'new'", 'CAST(NULL AS string)', 'lost', 'new', no_text, 'g.name', 'g.class')}) END"
        known = f"CASE WHEN size(lost) = 0 THEN transform(profile, p -> {cell("'old'", 'CAST(NULL AS string)', no_text, no_new, no_text, 'p.name', 'p.class')}) END"
        empty = "CAST(array() AS array<struct<side:string,src:string,lost:array<string>,new:array<struct<name:string,kind:string>>,retyped:array<string>,name:string,class:string>>)"
        cells = rows.selectExpr("object", f"inline(concat({whole}, coalesce({fresh}, {empty}), coalesce({known}, {empty})))")
        counted = cells.groupBy("object", "side", "src", "lost", "new", "retyped", "name", "class").agg(F.count(F.lit(1)).alias("n"))
        done = self.scratch.table(counted, "profiled").df
        self.layouts = done.where("side = 'layout'").select("src", "object", "lost", "new", "retyped", F.col("n").alias("lines"))
        self.sketches = done.where("side <> 'layout'").select("object", "lost", "new", "side", "name", "class", "n")

    def renames(self) -> DataFrame:
        """``object``, ``lost``, ``new`` (a version) and ``old_name``, ``new_name``, ``score`` of each column renamed there."""
        kinds = {o.path: {k: t for k, (t, _, _) in o.fields.items()} for o in self.objects}
        columns = self.sketches.groupBy("object", "lost", "new", "side", "name").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("sketch"))
        new = columns.where("side = 'new'").groupBy("object", "lost", "new").agg(F.map_from_entries(F.collect_list(F.struct("name", "sketch"))).alias("new_sketches"))
        old = columns.where("side = 'old'").groupBy("object").agg(F.map_from_entries(F.collect_list(F.struct("name", "sketch"))).alias("old_sketches"))
        versions = new.join(old, "object", "left").select("object", "lost", "new", "new_sketches", "old_sketches")

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for obj, lost, fresh, sketch, before in batch.itertuples(index=False):
                    sketch, before = ({k: dict(v) for k, v in dict(s or {}).items()} for s in (sketch, before))
                    score = [
                        [0.5 * name_similarity(a, b["name"]) + 0.5 * sketch_similarity(sketch.get(b["name"], {}), before.get(a, {})) if kinds[obj].get(a) in (b["kind"], "any") else -1.0 for b in fresh]
                        for a in lost
                    ]
                    out += [(obj, list(lost), [dict(b) for b in fresh], lost[i], fresh[j]["name"], score[i][j]) for i, j in best_matching(score)]
                yield pd.DataFrame(out, columns=["object", "lost", "new", "old_name", "new_name", "score"])

        schema = "object string, lost array<string>, new array<struct<name:string,kind:string>>, old_name string, new_name string, score double"
        return versions.mapInPandas(match, schema)

    def changes(self) -> DataFrame:
        """``src``, ``field``, ``change``: one row per file, field and kind of change."""
        per = self.renames().groupBy("object", "lost", "new").agg(F.collect_list("old_name").alias("gone"), F.collect_list("new_name").alias("come"))
        seen = self.layouts.join(per, ["object", "lost", "new"], "left")
        none = "CAST(array() AS array<string>)"
        scope = " OR ".join(f"x.field = '{s}' OR startswith(x.field, '{s}.')" for s in _SCOPE)
        full = lambda k: f"concat(CASE WHEN object = '' THEN '' ELSE concat(object, '.') END, {k})"
        gone, come = f"coalesce(gone, {none})", f"coalesce(come, {none})"
        rows = (
            f"concat(filter(transform(lost, k -> struct({full('k')} AS field, CASE WHEN array_contains({gone}, k) THEN 'renamed' ELSE 'removed' END AS change)), x -> {scope}), "
            f"transform(filter(new, g -> NOT array_contains({come}, g.name)), g -> struct({full('g.name')} AS field, 'added' AS change)), "
            f"transform(retyped, k -> struct({full('k')} AS field, 'retyped' AS change)))"
        )
        return seen.selectExpr("src", f"inline({rows})").distinct()

    def unified(self) -> DataFrame:
        """All assistant lines in one table: ``log_id``, ``src`` and a column per scalar field in scope, as text, from its old or its new name.

        A count written in another type than the schema's (a number in quotes, 12.0)
        is read as the whole number it stands for, else as null.
        """
        moves = self.renames().select("object", F.to_json(F.struct("lost", "new")).alias("version"), F.struct(F.concat_ws(".", F.when(F.col("object") != "", F.col("object")), "old_name").alias("k"), F.col("new_name").alias("n")).alias("move"))
        moves = self.scratch.table(moves.groupBy("object", "version").agg(F.map_from_entries(F.collect_list("move")).alias("moved")), "moves").df
        # A row per version is all that is joined; lines without one have a key of their own, so that they are no hot group.
        found = [f"try_element_at({self._object(o)}, 1) AS o{k}" for k, o in enumerate(self.objects)]
        drifted = lambda k: f"CASE WHEN size(o{k}.lost) > 0 AND size(o{k}.gained) > 0 THEN to_json(struct(o{k}.lost AS lost, transform(o{k}.gained, g -> struct(g.name AS name, g.kind AS kind)) AS new)) ELSE concat('-', log_id) END AS version{k}"
        rows = self.lines.selectExpr("log_id", "src", "v", *found).selectExpr("log_id", "src", "v", *[drifted(k) for k in range(len(found))])
        moved = {}
        for k, o in enumerate(self.objects):
            moved[o.path] = f"moved{k}"
            rows = rows.join(moves.where(F.col("object") == o.path).select(F.col("version").alias(f"version{k}"), F.col("moved").alias(moved[o.path])), f"version{k}", "left")
        rows = rows.withColumn("o", F.expr(f"try_cast(v AS {_OBJECT})"))
        columns, at = [], {"": "o"}

        def value(o: SchemaObject, name: str) -> str:
            key = f"{o.path}.{name}" if o.path else name
            m = at[o.path]
            return f"coalesce(element_at({m}, {_quoted(name)}), element_at({m}, element_at({moved[o.path]}, {_quoted(key)})))"

        for o in self.objects:
            for name, (kind, _, within) in o.fields.items():
                full = f"{o.path}.{name}" if o.path else name
                if kind == "object":
                    at[full] = "_" + full.replace(".", "_")
                    rows = rows.withColumn(at[full], F.expr(f"try_cast({value(o, name)} AS {_OBJECT})"))
                elif within:
                    x = value(o, name)
                    number = f"try_cast(CAST({x} AS string) AS decimal(38,9))"
                    whole = f"CASE WHEN {_kind(f'schema_of_variant({x})')} IN ('integer', 'number', 'string') AND {number} = floor({number}) THEN try_cast({number} AS bigint) END"
                    text = f"CASE WHEN {_kind(f'schema_of_variant({x})')} IN ('string', 'integer', 'number', 'boolean') THEN CAST({x} AS string) END"
                    columns.append(f"{whole if kind == 'integer' else text} AS {full.replace('.', '_')}")
        return rows.selectExpr("log_id", "src", *columns)
