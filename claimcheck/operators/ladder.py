"""Filtered aggregates over ranges: any number of texts in one pass over the dataset.

The texts of a template differ in the bounds that they claim. All bounds of a column, sorted, cut it
into elementary intervals, the rungs of a ladder. The dataset is aggregated once per rung; the rungs
are merged in blocks of two, four, eight and so on; and a claimed range is put together from at most
two blocks of each size. So nothing is subtracted, and minimum and maximum merge like sums do.

Equalities with a literal come first in the order of rungs, so that a ladder holds one part per key.
Conditions of another kind are evaluated per distinct set of their literals, if these are few.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from claimcheck.functions.guard import standard_literals
from claimcheck.functions.numbers import value_text
from claimcheck.operators.checked import checked_sql
from claimcheck.operators.ordered import running_total
from claimcheck.operators.templates import HOLE, SEPARATOR
from claimcheck.session import ClaimSession, materialize

# Templates with fewer texts than this share scans in blocks of literals instead.
LADDER_TEXTS = 100
# Distinct sets of literals of other conditions that one pass evaluates for every row.
OTHER_SETS = 32
LADDER_THREADS = 4

AGGREGATES = ("count", "sum", "avg", "min", "max")
_COMPARED = {"LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "EqualTo": "="}
_MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_HOLE_NAME = re.compile(r"_p\d+\Z")


@dataclass
class Leaf:
    """One aggregate inside a select list: its kind, argument and result type."""

    sql: str
    kind: str
    argument: str
    distinct: bool
    dtype: T.DataType | None = None


@dataclass
class Climb:
    """The texts of one template, taken apart.

    keys and ranged: expressions over the dataset; of_keys: expressions over the literals; bounds: (operator,
    expression over the literals); other: the remaining conditions.
    """

    template: str
    root: str
    leaves: list[Leaf]
    dtype: T.DataType
    keys: list[str] = field(default_factory=list)
    of_keys: list[str] = field(default_factory=list)
    ranged: str = ""
    bounds: list[tuple[str, str]] = field(default_factory=list)
    other: list[str] = field(default_factory=list)

    @property
    def base(self) -> tuple:
        return tuple(self.keys), self.ranged, tuple(self.other)


def _nodes(node) -> list:
    children = node.children()
    return [node, *[n for i in range(children.size()) for n in _nodes(children.apply(i))]]


def _children(node) -> list:
    children = node.children()
    return [children.apply(i) for i in range(children.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _holes(node) -> bool:
    return any(_kind(n) == "UnresolvedAttribute" and _HOLE_NAME.match(n.sql()) for n in _nodes(node))


def _columns(node) -> bool:
    return any(_kind(n) == "UnresolvedAttribute" and not _HOLE_NAME.match(n.sql()) for n in _nodes(node))


def _parse(session: ClaimSession, text: str):
    # Names in double quotes are back-quoted, so that they are names to any parser setting.
    named = re.sub(r"""('(?:[^']|'')*')|"([A-Za-z_]\w*)\"""", lambda m: m[1] or f"`{m[2]}`", text)
    return session.spark._jsparkSession.sessionState().sqlParser().parseExpression(standard_literals(named))


def _typed(literal: str, kind: str) -> str:
    return f"CAST('{literal.replace(chr(92), chr(92) * 2).replace(chr(39), chr(39) * 2)}' AS {kind})"


def _conjuncts(node) -> list:
    return [c for child in _children(node) for c in _conjuncts(child)] if _kind(node) == "And" else [node]


def take_apart(session: ClaimSession, row: Row, errors: tuple) -> Climb | None:
    """The parts of a template, or nothing when its aggregates or conditions cannot be merged.

    row: template, text (one of its texts), constants (per literal its value where all texts have the same, or None).
    """
    select, predicate, kinds = row["template"].split(SEPARATOR)
    try:
        # The text itself must be accepted: only then are its parts run.
        accepted = checked_sql(session, row["text"])
        if len(accepted.columns) != 1:
            return None
        holes = [
            f"_p{i}" if constant is None else _typed(constant, kind)
            for i, (constant, kind) in enumerate(zip(row["constants"], kinds.split(",")))
        ]
        pieces = predicate.split(HOLE)
        filter_ = _parse(session, pieces[0] + "".join(h + p for h, p in zip(holes, pieces[1:])))
        root = _parse(session, select)
        if _kind(root) == "Alias":
            root = _children(root)[0]
        leaves = _leaves(root)
        if not leaves or re.search(r"'[^']*\([^']*'", select):
            return None
        climb = Climb(row["template"], root.sql(), leaves, accepted.schema[0].dataType)
        for leaf in leaves:
            typed = checked_sql(session, f"SELECT {leaf.kind}({leaf.argument}) FROM data")
            leaf.dtype = typed.schema[0].dataType
    except errors:
        return None
    for condition in _conjuncts(filter_):
        _sort_condition(climb, condition)
    if any(leaf.distinct and leaf.argument != climb.ranged for leaf in leaves):
        # Distinct values add up over rungs only where rungs part these values.
        return None
    return climb


def _leaves(root) -> list[Leaf] | None:
    """The aggregates of a select list; nothing if one is of another kind."""
    if _kind(root) != "UnresolvedFunction":
        found = [_leaves(c) for c in _children(root)]
        return None if any(f is None for f in found) else _distinct([leaf for f in found for leaf in f])
    name = root.nameParts().mkString(".").lower()
    if name in AGGREGATES:
        arguments = _children(root)
        if len(arguments) != 1 or root.filter().isDefined() or root.isDistinct() and name != "count":
            return None
        return [Leaf(root.sql(), name, arguments[0].sql(), root.isDistinct())]
    if re.fullmatch(r"median|mode|mean|stddev\w*|std|variance|var_\w+|percentile\w*|count_if|any_value|first\w*|last\w*|\w*_agg|collect_\w+|bool_\w+|bit_\w+|approx_\w+|corr|covar_\w+|skewness|kurtosis|max_by|min_by|every|some|any|grouping\w*|regr_\w+|hist\w*|product|listagg", name):
        return None
    found = [_leaves(c) for c in _children(root)]
    return None if any(f is None for f in found) else _distinct([leaf for f in found for leaf in f])


def _distinct(leaves: list[Leaf]) -> list[Leaf] | None:
    known: dict[str, Leaf] = {}
    for leaf in leaves:
        # Written alike, though only one of them counts distinct values.
        if known.setdefault(leaf.sql, leaf).distinct != leaf.distinct:
            return None
    return list(known.values())


def _sort_condition(climb: Climb, condition) -> None:
    """Put a condition where it belongs: key, bound or other."""
    kind, parts = _kind(condition), _children(condition)
    found: list[tuple[str, str, str]] = []
    if kind in _COMPARED:
        op = _COMPARED[kind]
        if _holes(parts[0]) and not _columns(parts[0]):
            parts, op = parts[::-1], _MIRRORED[op]
        found = [(parts[0].sql(), op, parts[1])]
    elif kind == "UnresolvedFunction" and condition.nameParts().mkString(".") == "between":
        found = [(parts[0].sql(), ">=", parts[1]), (parts[0].sql(), "<=", parts[2])]
    splits = found and not _holes(parts[0]) and _columns(parts[0]) and all(_holes(v) and not _columns(v) for _, _, v in found)
    if splits and found[0][1] == "=" and found[0][0] not in climb.keys:
        climb.keys.append(found[0][0])
        climb.of_keys.append(found[0][2].sql())
    elif splits and found[0][1] != "=" and climb.ranged in ("", found[0][0]):
        climb.ranged = found[0][0]
        climb.bounds += [(op, value.sql()) for _, op, value in found]
    else:
        climb.other.append(condition.sql())


def _wide(data: T.DataType, literal: T.DataType) -> str | None:
    """The type in which Spark compares the two; nothing where it depends on values."""
    numbers = (*_INTEGRAL, T.FloatType, T.DoubleType)
    if isinstance(data, numbers) and isinstance(literal, numbers):
        return "bigint" if isinstance(data, _INTEGRAL) and isinstance(literal, _INTEGRAL) else "double"
    for time, name in ((T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp_ntz")):
        if isinstance(data, (T.DateType, time)) and isinstance(literal, (T.DateType, time)):
            return "date" if isinstance(data, T.DateType) and isinstance(literal, T.DateType) else name
    return "string" if isinstance(data, T.StringType) and isinstance(literal, T.StringType) else None


def _literals(session: ClaimSession, texts: DataFrame, climb: Climb) -> DataFrame:
    """(_text, _counted, _p0, ...): the literals of a template's texts in their types."""
    kinds = climb.template.split(SEPARATOR)[2].split(",")
    rows = texts.where(F.col("template") == climb.template)
    return rows.select(
        F.col("_run_text").alias("_text"),
        F.col("count_text").isNotNull().alias("_counted"),
        *[F.col("literals")[i].cast(k.lower()).alias(f"_p{i}") for i, k in enumerate(kinds)],
    )


@dataclass
class Ladder:
    """Templates that share keys, ranged column and other conditions, and the columns they merge."""

    session: ClaimSession
    texts: DataFrame
    climbs: list[Climb]

    def run(self, nothing) -> list[DataFrame] | None:
        """(_run_text, _text_raw, _text_error, _text_rows) per template, or nothing where this way does not apply.

        nothing: what a select list gives over no rows, (raw, error). Where that is an error, its texts are left out.
        """
        first = self.climbs[0]
        sides = [_literals(self.session, self.texts, c) for c in self.climbs]
        wide = self._types(sides)
        if wide is None:
            return None
        others = self._other_sets(sides)
        if others is None:
            return None
        aggregates = self._aggregates()
        rungs = materialize(self._partials(aggregates, wide, others), "rungs")
        claims = [materialize(self._claims(side, c, wide, others), "claims") for side, c in zip(sides, self.climbs)]
        at = ["_other", *[f"_k{i}" for i in range(len(first.keys))], "_edge", "_x", "_side"]
        ends = [d.select(F.explode(F.array("_low", "_high")).alias("_at")).select("_at.*") for d in claims]
        cuts = reduce(DataFrame.unionByName, ends).distinct().withColumn("_cut", F.lit(1))
        placed = rungs.withColumns({"_edge": F.lit(0), "_side": F.lit(1), "_cut": F.lit(0)}).unionByName(cuts, allowMissingColumns=True)
        sliced = placed.repartitionByRange(*at).withColumns({"_slice": F.spark_partition_id(), "_at": F.struct(*at)})
        ordered = running_total(materialize(sliced, "ladder"), [], "_at", "_slice", F.col("_cut"), "_rung")
        ordered = materialize(ordered, "ordered-ladder")
        n_cuts = ordered.agg(F.max("_rung")).first()[0] or 0
        levels = max(n_cuts + 1, 1).bit_length()
        merged = lambda frame, *by: frame.groupBy(*by).agg(*[c for a in aggregates for c in a.merged()])
        single = materialize(merged(ordered.where("_cut = 0"), "_rung"), "single-rungs")
        level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")
        up = single.select("*", level).withColumn("_block", F.expr("shiftright(_rung, _level)"))
        blocks = materialize(merged(up, "_level", "_block"), "ladder-blocks")
        places = ordered.where("_cut = 1").select("_at", "_rung")
        return [
            self._answers(c, self._reached(claim, places, blocks, levels, merged), aggregates, nothing)
            for c, claim in zip(self.climbs, claims)
        ]

    def _types(self, sides: list[DataFrame]) -> list[str] | None:
        """The types of keys and ranged column in which they meet the literals of every template."""
        first, found = self.climbs[0], []
        data = self.session.spark.sql(f"SELECT {', '.join([*first.keys, first.ranged or '0'])} FROM data").schema
        for climb, side in zip(self.climbs, sides):
            literal = lambda sql: side.select(F.expr(sql)).schema[0].dataType  # noqa: B023, E731
            kinds = [_wide(data[i].dataType, literal(sql)) for i, sql in enumerate(climb.of_keys)]
            ranged = {_wide(data[len(first.keys)].dataType, literal(sql)) for _, sql in climb.bounds} or {"bigint"}
            found.append([*kinds, *ranged])
        same = len(set(map(tuple, found))) == 1 and len(found[0]) == len(first.keys) + 1 and None not in found[0]
        return found[0] if same else None

    def _other_sets(self, sides: list[DataFrame]) -> DataFrame | str | None:
        """The sets of literals of the other conditions, broadcast with a number; '' where there are no literals.

        Nothing when the sets are many, or when templates with such literals would share a ladder.
        """
        names = sorted({n for text in self.climbs[0].other for n in re.findall(r"\b_p\d+\b", text)})
        if not names:
            return ""
        if len(self.climbs) > 1:
            return None
        sets = sides[0].select(*names).distinct().limit(OTHER_SETS + 1).collect()
        if len(sets) > OTHER_SETS:
            return None
        schema = T.StructType([T.StructField("_other", T.IntegerType()), *[sides[0].schema[n] for n in names]])
        return self.session.spark.createDataFrame([(i, *s) for i, s in enumerate(sets)], schema)

    def _aggregates(self) -> list[Merged]:
        leaves = {(leaf.sql, leaf.distinct): leaf for c in self.climbs for leaf in c.leaves}
        return [Merged("_n", Leaf("count(1)", "count", "1", False, T.LongType())), *[Merged(f"_a{i}", leaf) for i, leaf in enumerate(leaves.values())]]

    def _partials(self, aggregates: list[Merged], wide: list[str], others: DataFrame | str) -> DataFrame:
        """One pass: partial aggregates per set of other literals, keys and value of the ranged column."""
        first = self.climbs[0]
        by = [f"CAST({k} AS {w})" for k, w in zip(first.keys, wide)] + [f"CAST({first.ranged or '0'} AS {wide[-1]})"]
        names = [*[f"_k{i}" for i in range(len(first.keys))], "_x"]
        condition = " AND ".join(f"({c})" for c in first.other) or "true"
        view = f"sets_{uuid.uuid4().hex}"
        if isinstance(others, DataFrame):
            others.createOrReplaceTempView(view)
            source, other = f"data JOIN {view} ON ({condition})", "_other"
            hint = f"/*+ BROADCAST({view}) */ "
        else:
            source, other, hint = f"data WHERE true AND {condition}", "0", ""
        items = [f"{other} AS _other", *[f"{e} AS {n}" for e, n in zip(by, names)], *[p for a in aggregates for p in a.partials()]]
        groups = ", ".join([str(i + 1) for i in range(1 + len(by))])
        try:
            frame = self.session.spark.sql(f"SELECT {hint}{', '.join(items)} FROM {source} GROUP BY {groups}")
        finally:
            self.session.spark.catalog.dropTempView(view)
        return frame.where(" AND ".join(f"{n} IS NOT NULL" for n in names))

    def _claims(self, side: DataFrame, climb: Climb, wide: list[str], others: DataFrame | str) -> DataFrame:
        """(_text, _counted, _low, _high): the places between which a text's rows lie."""
        if isinstance(others, DataFrame):
            names = [c for c in others.columns if c != "_other"]
            same = reduce(Column.__and__, [side[n].eqNullSafe(others[n]) for n in names])
            side = side.join(F.broadcast(others), same).select(*[side[c] for c in side.columns], others["_other"])
        else:
            side = side.withColumn("_other", F.lit(0))
        keys = [F.expr(sql).cast(w).alias(f"_k{i}") for i, (sql, w) in enumerate(zip(climb.of_keys, wide))]
        place = lambda edge, x, right: F.struct(
            "_other", *keys, F.lit(edge).alias("_edge"), x.cast(wide[-1]).alias("_x"), F.lit(right).alias("_side")
        )
        ends = {-1: [place(-1, F.lit(None), 0)], 1: [place(1, F.lit(None), 0)]}
        for op, sql in climb.bounds:
            # Rows at the value itself lie between the places before (0) and after it (2).
            ends[-1 if op in (">", ">=") else 1].append(place(0, F.expr(sql), 2 if op in (">", "<=") else 0))
        return side.select("_text", "_counted", F.array_max(F.array(*ends[-1])).alias("_low"), F.array_min(F.array(*ends[1])).alias("_high"))

    @staticmethod
    def _reached(claims: DataFrame, places: DataFrame, blocks: DataFrame, levels: int, merged) -> DataFrame:
        """The claims with the merged partials of all blocks between their ends."""
        low = places.select(F.col("_at").alias("_low"), (F.col("_rung") + 1).alias("_from"))
        high = places.select(F.col("_at").alias("_high"), (F.col("_rung") + 1).alias("_to"))
        ranged = claims.join(low, "_low").join(high, "_high").select("_text", "_counted", "_from", "_to")
        steps = ranged.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns(
            {
                "_a": F.expr("shiftright(_from + shiftleft(1L, _level) - 1, _level)"),
                "_b": F.expr("shiftright(_to, _level)"),
            }
        )
        # Blocks that no larger one covers: an odd first, and the one before an odd end.
        taken = F.array(
            F.when((F.col("_a") < F.col("_b")) & (F.col("_a") % 2 == 1), F.col("_a")),
            F.when((F.col("_b") % 2 == 1) & (F.col("_a") + F.col("_a") % 2 < F.col("_b")), F.col("_b") - 1),
        )
        taken = steps.select("_text", "_level", F.explode(F.array_compact(taken)).alias("_block"))
        found = merged(taken.join(blocks, ["_level", "_block"]), "_text")
        return claims.select("_text", "_counted").join(found, "_text", "left")

    def _answers(self, climb: Climb, reached: DataFrame, aggregates: list[Merged], nothing) -> DataFrame:
        root, columns = climb.root, {}
        for merged in aggregates[1:]:
            if any(leaf.sql == merged.leaf.sql and leaf.distinct == merged.leaf.distinct for leaf in climb.leaves):
                columns[f"_v{merged.name}"] = merged.value()
                root = root.replace(merged.leaf.sql, f"_v{merged.name}")
        value = F.expr(root).cast(climb.dtype)
        shown = reached.where("_n IS NOT NULL").withColumns(columns).select(
            "_text", F.coalesce(value_text(value, climb.dtype), F.lit("")).alias("_text_raw"), "_n", "_counted"
        )
        raw, error = nothing(climb.template.split(SEPARATOR)[0])
        if error is None:
            empty = reached.where("_n IS NULL").select("_text", F.lit(raw).alias("_text_raw"), F.lit(0).cast("long").alias("_n"), "_counted")
            shown = shown.unionByName(empty)
        return shown.select(
            F.col("_text").alias("_run_text"),
            "_text_raw",
            F.lit(None).cast("string").alias("_text_error"),
            F.when(F.col("_counted"), F.col("_n")).alias("_text_rows"),
        )


@dataclass
class Merged:
    """A leaf as partial aggregates that add up."""

    name: str
    leaf: Leaf

    def partials(self) -> list[str]:
        kind, argument = self.leaf.kind, self.leaf.argument
        if self.leaf.distinct:
            # Rungs begin as single values of this very expression.
            return [f"CAST(count({argument}) > 0 AS BIGINT) AS {self.name}"]
        if kind == "avg":
            wide = f"CAST({argument} AS DOUBLE)" if isinstance(self.leaf.dtype, T.DoubleType) else argument
            return [f"sum({wide}) AS {self.name}_sum", f"count({argument}) AS {self.name}"]
        return [f"{kind}({argument}) AS {self.name}"]

    def merged(self) -> list[Column]:
        kind, name = self.leaf.kind, self.name
        if kind == "avg":
            return [F.try_sum(f"{name}_sum").alias(f"{name}_sum"), F.sum(name).alias(name)]
        merge = {"count": F.sum, "sum": F.try_sum, "min": F.min, "max": F.max}[kind]
        return [merge(name).alias(name)]

    def value(self) -> Column:
        value = F.try_divide(f"{self.name}_sum", self.name) if self.leaf.kind == "avg" else F.col(self.name)
        return value.cast(self.leaf.dtype)


def ladder_rows(session: ClaimSession, texts: DataFrame, run_query, errors: tuple) -> list[DataFrame]:
    """Results of the texts whose templates are frequent enough and can be merged, as written tables.

    texts: _run_text, count_text, template, literals. Templates, not texts, are counted on the driver. One whose
    pass fails is left out, as are texts over no rows whose select list fails there: they run as before.
    """
    templates = texts.where("template IS NOT NULL")
    often = templates.groupBy("template").agg(F.count("*").alias("n"), F.min("_run_text").alias("text")).where(F.col("n") >= LADDER_TEXTS)
    often = materialize(often, "templates")
    if not (found := often.collect()):
        return []
    same = (
        templates.join(F.broadcast(often.select("template")), "template", "left_semi")
        .select("template", F.posexplode("literals").alias("i", "literal"))
        .groupBy("template", "i")
        .agg(F.min("literal").alias("low"), F.max("literal").alias("high"))
        .collect()
    )
    constants: dict[str, list] = {}
    for row in sorted(same, key=lambda r: (r["template"], r["i"])):
        constants.setdefault(row["template"], []).append(row["low"] if row["low"] == row["high"] else None)
    bases: dict[tuple, list[Climb]] = {}
    for row in found:
        climb = take_apart(session, Row(template=row["template"], text=row["text"], constants=constants[row["template"]]), errors)
        if climb is not None:
            alone = climb.template if any(re.search(r"\b_p\d+\b", c) for c in climb.other) else ""
            bases.setdefault((*climb.base, alone), []).append(climb)

    def run(climbs: list[Climb]) -> list[DataFrame]:
        nothing = lambda select: run_query(session, f"SELECT {select} FROM data WHERE false")
        try:
            return [materialize(rows, "ladder-texts") for rows in Ladder(session, texts, climbs).run(nothing) or []]
        except errors:
            return [] if len(climbs) == 1 else [rows for c in climbs for rows in run([c])]

    with ThreadPoolExecutor(LADDER_THREADS) as pool:
        return [rows for done in pool.map(run, bases.values()) for rows in done]
