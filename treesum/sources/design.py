"""Column roles, formulas and the frozen design: DataFrames to a response and a numeric predictor array.

A design is resolved once on training data (levels, constant columns, names) and then applied to any DataFrame."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesum.sources.formula import Atom, DesignError, parse, parse_term, term_name


def parse_formula(formula: str, columns: list[str]) -> tuple[str, list[str]]:
    """A formula to (response, terms) as texts that `resolve` and `model_frame` read; see `formula` for what may stand in it."""
    f = parse(formula, columns)
    named = lambda a: a.columns[0] if a.columns and a.text.strip("`") == a.columns[0] else a.text
    return named(f.response), [named(t[0]) if len(t) == 1 and t[0].sql is None and not t[0].levels else term_name(t) for t in f.terms]


def number(text: str, columns: list[str]) -> Column:
    """A column, or arithmetic of columns, as a number."""
    return F.col(text).cast("double") if text in columns else F.expr(parse(f"{text} ~ 1 + .", [*columns, ""]).response.sql)


def formula_frame(df: DataFrame, formula: str, row_id: str, weight: Column | None = None, offset: Column | None = None, group: str | None = None, drop: bool = True) -> tuple[DataFrame, Design]:
    """(model frame, frozen design) of a formula over the complete rows of df; offset(...) terms add to the offset."""
    f = parse(formula, df.columns)
    response, terms = parse_formula(formula, df.columns)
    used = [*f.response.columns, *(c for t in f.terms for a in t for c in a.columns), *(c for a in f.offset for c in a.columns)]
    design = resolve(complete(df, list(dict.fromkeys(used))), terms, drop)
    off = [F.expr(a.sql) for a in f.offset] + ([] if offset is None else [offset])
    return model_frame(df, F.expr(f.response.sql) if response not in df.columns else response, design, row_id, weight, sum(off[1:], off[0]) if off else None, group), design


@dataclass(frozen=True)
class Term:
    """One term: kind 'number' (a column, or sql), 'factor' (levels kept), 'array' (positions kept) or 'product' (places kept
    among the products of the columns of its parts)."""

    name: str
    kind: str
    keep: tuple = ()
    counts: dict = field(default_factory=dict)
    sql: str | None = None
    inputs: tuple = ()
    parts: tuple[Term, ...] = ()

    def names(self) -> list[str]:
        if self.kind == "number":
            return [self.name] if self.keep else []
        if self.kind == "product":
            return [":".join(n) for i, n in enumerate(product(*(p.names() for p in self.parts))) if i in self.keep]
        return [f"{self.name}.{k}" if self.kind == "factor" else f"{self.name}.{k + 1}" for k in self.keep]

    def columns(self) -> list[Column]:
        if self.kind == "product":
            return [reduce(mul, c) for i, c in enumerate(product(*(p.columns() for p in self.parts))) if i in self.keep]
        if self.kind == "number":
            return [F.expr(self.sql) if self.sql else F.col(self.name).cast("double")] if self.keep else []
        c = F.col(self.inputs[0] if self.inputs else self.name)
        if self.kind == "factor":
            c = c.cast("string")
            return [F.when(c.isNull(), None).otherwise((c == k).cast("double")) for k in self.keep]
        return [F.get(c, F.lit(k)).cast("double") for k in self.keep]

    def wanted(self) -> list[str]:
        """The columns it reads."""
        return [c for p in self.parts for c in p.wanted()] if self.parts else list(self.inputs or (self.name,))


@dataclass(frozen=True)
class Design:
    terms: tuple[Term, ...]

    @property
    def names(self) -> list[str]:
        return [n for t in self.terms for n in t.names()]

    def columns(self) -> list[Column]:
        return [c.alias(n) for t in self.terms for c, n in zip(t.columns(), t.names(), strict=True)]

    def array(self) -> Column:
        return F.array(*(c for t in self.terms for c in t.columns()))

    def matched(self, df: DataFrame) -> DataFrame:
        """df with the design's input columns, by name, or by position where the names differ (with a warning)."""
        want = list(dict.fromkeys(c for t in self.terms for c in t.wanted()))
        if set(want) <= set(df.columns):
            return df
        if len(df.columns) != len(want):
            raise DesignError(f"{len(want)} columns wanted, {len(df.columns)} given")
        warnings.warn("column names differ from those of training; columns are matched by position", stacklevel=2)
        return df.toDF(*want)

    def matrix(self, df: DataFrame, *keep: str) -> DataFrame:
        """keep and one column per predictor."""
        return self.matched(df).select(*keep, *self.columns())


_NUMBER = (T.NumericType, T.BooleanType)


#: Levels a factor may have.
MOST_LEVELS = 1000


def resolve(df: DataFrame, terms: list[str], drop: bool = True) -> Design:
    """The design of terms over df: one pass of minima and maxima for numbers, array elements and products, one count per
    factor. A factor of more than two present levels gives a column each, of two one for the last; constant columns go. Terms
    are columns, or texts as in formulas: numbers computed from columns, products (of which a factor gives each level's)."""
    atoms = {t: parse_term(t, df.columns) for t in terms if t not in df.columns}
    if not atoms:
        return _plain_design(df, terms, drop)
    kinds = {f.name: f.dataType for f in df.schema}

    def part(a: Atom) -> Term:
        if a.sql is not None:
            return Term(a.text, "number", (0,), {}, a.sql, a.columns)
        c = a.columns[0]
        if a.levels or isinstance(kinds[c], T.StringType):
            (t,) = _plain_design(df.select(F.col(c).cast("string").alias(c)), [c], drop).terms
            return replace(t, name=a.text.strip("`"), inputs=(c,))
        (t,) = _plain_design(df, [c], False).terms
        return t

    def term(t: str) -> Term:
        if t not in atoms:
            return _plain_design(df, [t], drop).terms[0]
        if len(atoms[t]) == 1:
            return part(atoms[t][0])
        parts = tuple(part(a) for a in atoms[t])
        return Term(t, "product", tuple(range(len(list(product(*(p.names() for p in parts)))))), {}, None, (), parts)

    found = [term(t) for t in terms]
    # computed columns that are constant go, by one pass over all of them
    computed = [(i, k, c) for i, t in enumerate(found) if terms[i] in atoms and t.kind in ("number", "product") for k, c in zip(t.keep, t.columns(), strict=True)]
    if drop and computed:
        row = df.agg(*[a for j, (_, _, c) in enumerate(computed) for a in (F.min(c).alias(f"lo{j}"), F.max(c).alias(f"hi{j}"))]).first()
        gone = {(i, k) for j, (i, k, _) in enumerate(computed) if row[f"lo{j}"] == row[f"hi{j}"]}
        found = [replace(t, keep=tuple(k for k in t.keep if (i, k) not in gone)) if any(g == i for g, _ in gone) else t for i, t in enumerate(found)]
    return Design(tuple(found))


def _plain_design(df: DataFrame, terms: list[str], drop: bool) -> Design:
    """Terms that are columns."""
    kinds = {f.name: f.dataType for f in df.schema}
    numbers = [t for t in terms if isinstance(kinds[t], _NUMBER)]
    arrays = [t for t in terms if isinstance(kinds[t], T.ArrayType) and isinstance(kinds[t].elementType, _NUMBER)]
    factors = [t for t in terms if isinstance(kinds[t], T.StringType)]
    for t in terms:
        if t not in numbers + arrays + factors:
            raise DesignError(f"column {t!r} of type {kinds[t].simpleString()} is neither a number, a string nor an array of numbers")
    widths = {}
    if arrays:
        row = df.agg(*[F.max(F.size(t)).alias(t) for t in arrays]).first()
        widths = {t: row[t] or 0 for t in arrays}
    cells = [(t, None, F.col(t).cast("double")) for t in numbers] + [(t, k, F.get(F.col(t), F.lit(k)).cast("double")) for t in arrays for k in range(widths[t])]
    spread = {}
    if cells:
        row = df.agg(*[a for i, (_, _, c) in enumerate(cells) for a in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
        spread = {(t, k): row[f"lo{i}"] != row[f"hi{i}"] for i, (t, k, _) in enumerate(cells)}
    out = []
    for t in terms:
        if t in numbers:
            out.append(Term(t, "number", (0,) if spread[t, None] or not drop else ()))
        elif t in arrays:
            out.append(Term(t, "array", tuple(k for k in range(widths[t]) if spread[t, k] or not drop)))
        else:
            # one row more than there may be levels
            found = factor_table(df, t).limit(MOST_LEVELS + 1).collect()
            if len(found) > MOST_LEVELS:
                raise DesignError(f"column {t!r} has more than {MOST_LEVELS} levels; each would be a predictor")
            counts = {r[t]: r["count"] for r in found}
            levels = sorted(counts)
            out.append(Term(t, "factor", tuple(levels if len(levels) > 2 else levels[1:] if drop or len(levels) == 2 else levels), counts))
    return Design(tuple(out))


def factor_table(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).count()


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, constant) in one pass."""
    row = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("constant")) for c in columns])).alias("x")).select("x.*")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def split_probabilities(design: Design, given: float | list[float] | dict[str, float] | None) -> list[float] | None:
    """One probability per predictor: a scalar or equal values mean uniform (None); a dict goes by column or term name,
    a term's value for each of its columns, '.default' for the rest."""
    if given is None or isinstance(given, (int, float)):
        return None
    if isinstance(given, dict):
        out = []
        for t in design.terms:
            for n in t.names():
                v = given.get(n, given.get(t.name, given.get(".default")))
                if v is None:
                    raise DesignError(f"no split probability for {n!r} and no .default")
                out.append(float(v))
    else:
        out = [float(v) for v in given]
        if len(out) != len(design.names):
            raise DesignError(f"{len(design.names)} split probabilities wanted, {len(out)} given")
    if min(out) < 0 or sum(out) <= 0:
        raise DesignError("split probabilities must be positive")
    if len(set(out)) == 1:
        return None
    return [v / sum(out) for v in out]


def model_frame(df: DataFrame, response: str | Column, design: Design, row_id: str, weight: Column | None = None, offset: Column | None = None, group: str | None = None) -> DataFrame:
    """(row_id, y, weight, offset, x[, g]) with incomplete rows dropped."""
    y = number(response, df.columns) if isinstance(response, str) else response
    cols = [F.col(row_id).cast("long").alias("row_id"), y.cast("double").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"), (offset if offset is not None else F.lit(0.0)).cast("double").alias("offset"), design.array().alias("x")]
    out = df.select(*cols, *([F.col(group).alias("g")] if group else []))
    return out.where(F.col("y").isNotNull() & F.col("weight").isNotNull() & F.col("offset").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def is_binary(frame: DataFrame) -> bool:
    r = frame.agg(F.min("y"), F.max("y"), F.bool_and(F.col("y").isin(0.0, 1.0))).first()
    return r[0] == 0 and r[1] == 1 and bool(r[2])


def encode(df: DataFrame, terms: list[str] | None = None, drop: bool = True) -> DataFrame:
    """One column per predictor of df's terms (all columns, if none are named); also known as make_indicators."""
    return resolve(df, terms or df.columns, drop).matrix(df)


make_indicators = encode


def subset(df: DataFrame, condition: Column | str) -> DataFrame:
    """The rows a model is to see; a condition that is null leaves a row out."""
    return df.where(condition)


def offset_response(frame: DataFrame, times: float = 1.0) -> DataFrame:
    """frame with its offset taken off the response, `times` over."""
    return frame.withColumn("y", F.col("y") - F.lit(times) * F.col("offset"))


def latent_start(frame: DataFrame) -> DataFrame:
    """frame(y 0 or 1) with z, where the latents of a probit chain start: -1 or 1."""
    return frame.withColumn("z", F.col("y") * 2.0 - 1.0)


def by_position(df: DataFrame, row_id: str, array: str) -> tuple[DataFrame, list[str]]:
    """The matrix mode: an array column as predictors V1, V2, ... by position, and their names."""
    width = df.select(F.max(F.size(array))).first()[0] or 0
    names = [f"V{i + 1}" for i in range(width)]
    return df.select(F.col(row_id).alias("row_id"), *[F.get(F.col(array), F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names
