"""A SPARQL subset compiled to DataFrames: Catalyst plans what comes out.

SELECT and ASK; PREFIX; basic graph patterns with ; and ,; paths of steps (p1/p2), their
inverses (^p) and alternatives (p1|p2); FILTER, also [NOT] EXISTS; OPTIONAL; UNION; MINUS; BIND; VALUES; DISTINCT;
GROUP BY with COUNT, SUM, AVG, MIN, MAX and HAVING; ORDER BY; LIMIT; OFFSET. Patterns are joined in an order in which
each shares a variable with those before it, if there is one. Data are rows (s, p, o), with constants compared as strings: an IRI is
its text without brackets, a literal its lexical form. With `keys`, patterns are matched within
the rows that share those columns (a question asked of each document).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = {"schema": "http://schema.org/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "owl": "http://www.w3.org/2002/07/owl#", "foaf": "http://xmlns.com/foaf/0.1/"}
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')(?:@[\w-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]+))?
    |(?P<num>[+-]?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w.-]*\w|:[\w-]+|[A-Za-z_][\w-]*:)|(?P<word>[A-Za-z]\w*)
    |(?P<op>&&|\|\||!=|<=|>=|[{}().;,=<>!*/+|^-])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class SparqlError(ValueError):
    """A query outside the subset."""


def _tokens(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise SparqlError(f"can't read {query[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


@dataclass(frozen=True)
class Term:
    kind: str  # var, iri, literal, number
    value: str


@dataclass
class Group:
    """parts: ("triple", s, p, o), ("filter", expression), ("optional", Group), ("union", [Group]), ("minus", Group), ("bind", expression, name), ("values", names, rows)."""

    parts: list[tuple] = field(default_factory=list)


@dataclass
class Query:
    form: str
    names: list[str] | None
    where: Group
    distinct: bool = False
    order: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    computed: dict[str, tuple] = field(default_factory=dict)  # SELECT (expression AS ?name)
    by: list[str] | None = None
    having: list[tuple] = field(default_factory=list)


class _Parser:
    def __init__(self, query: str):
        self.t, self.i, self.prefixes, self.hidden = _tokens(query), 0, dict(PREFIXES), 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][1].upper() in values and self.t[self.i][0] in ("word", "op")

    def take(self, *values: str) -> bool:
        ok = self.peek(*values)
        self.i += ok
        return ok

    def need(self, value: str) -> None:
        if not self.take(value):
            raise SparqlError(f"{value} is missing before {self.t[self.i : self.i + 1]}")

    def next(self) -> tuple[str, str]:
        if self.i >= len(self.t):
            raise SparqlError("the query ends too early")
        self.i += 1
        return self.t[self.i - 1]

    def term(self) -> Term:
        kind, x = self.next()
        if kind == "var":
            return Term("var", x[1:])
        if kind == "iri":
            return Term("iri", x[1:-1])
        if kind == "str":
            return Term("literal", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), x[1:-1]))
        if kind == "num":
            return Term("number", x)
        if kind == "name":
            prefix, _, local = x.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix}")
            return Term("iri", self.prefixes[prefix] + local)
        if x == "a":
            return Term("iri", PREFIXES["rdf"] + "type")
        if x.lower() in ("true", "false"):
            return Term("literal", x.lower())
        raise SparqlError(f"no term: {x}")

    def query(self) -> Query:
        while self.take("PREFIX"):
            name, iri = self.next()[1], self.next()[1]
            self.prefixes[name.rstrip(":")] = iri[1:-1]
        if self.take("ASK"):
            self.take("WHERE")
            q = Query("ask", None, self.group())
        else:
            self.need("SELECT")
            distinct = self.take("DISTINCT")
            names: list[str] | None = []
            computed: dict[str, tuple] = {}
            if self.take("*"):
                names = None
            else:
                while self.t[self.i][0] == "var" or self.peek("("):
                    if self.take("("):
                        e = self.either()
                        self.need("AS")
                        names.append(self.next()[1][1:])
                        computed[names[-1]] = e
                        self.need(")")
                    else:
                        names.append(self.next()[1][1:])
                if not names:
                    raise SparqlError("SELECT names no variables")
            self.take("WHERE")
            q = Query("select", names, self.group(), distinct, computed=computed)
            if self.take("GROUP"):
                self.need("BY")
                q.by = []
                while self.i < len(self.t) and self.t[self.i][0] == "var":
                    q.by.append(self.next()[1][1:])
            while self.take("HAVING"):
                q.having.append(self.single())
            if self.take("ORDER"):
                self.need("BY")
                while self.i < len(self.t) and not self.peek("LIMIT", "OFFSET"):
                    down = self.peek("DESC")
                    if self.take("ASC", "DESC"):
                        self.need("(")
                        q.order.append((self.either(), down))
                        self.need(")")
                    else:
                        q.order.append((self.single(), False))
            while self.peek("LIMIT", "OFFSET"):
                which, n = self.next()[1].lower(), int(self.next()[1])
                setattr(q, which, n)
        if self.i < len(self.t):
            raise SparqlError(f"not understood: {self.t[self.i][1]}")
        return q

    def group(self) -> Group:
        self.need("{")
        g = Group()
        while not self.take("}"):
            if self.take("FILTER"):
                g.parts.append(("filter", self.single()))
            elif self.take("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.take("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.take("BIND"):
                self.need("(")
                e = self.either()
                self.need("AS")
                g.parts.append(("bind", e, self.next()[1][1:]))
                self.need(")")
            elif self.take("VALUES"):
                g.parts.append(self.values())
            elif self.peek("{"):
                options = [self.group()]
                while self.take("UNION"):
                    options.append(self.group())
                g.parts.append(("union", options))
            else:
                s = self.term()
                while True:
                    p = self.path()
                    g.parts += self.steps(s, p, self.term())
                    while self.take(","):
                        g.parts += self.steps(s, p, self.term())
                    if not self.take(";"):
                        break
                    if self.peek(".", "}"):
                        break
            self.take(".")
        return g

    def values(self) -> tuple:
        many = self.take("(")
        names = []
        while self.t[self.i][0] == "var":
            names.append(self.next()[1][1:])
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
            rows.append(tuple(None if self.take("UNDEF") else self.term().value for _ in names))
            if many:
                self.need(")")
        return ("values", names, rows)

    def path(self) -> list[list[tuple[Term, bool]]]:
        """Steps, each a list of alternatives (predicate, whether it is followed backwards)."""
        steps = [self.step()]
        while self.take("/"):
            steps.append(self.step())
        return steps

    def step(self) -> list[tuple[Term, bool]]:
        if self.take("("):
            out = self.step()
            self.need(")")
            return out
        back = self.take("^")
        out = [(self.term(), back)]
        while self.take("|"):
            back = self.take("^")
            out.append((self.term(), back))
        return out

    def steps(self, s: Term, path: list[list[tuple[Term, bool]]], o: Term) -> list[tuple]:
        out, at = [], s
        for k, step in enumerate(path):
            if k + 1 < len(path):
                self.hidden += 1
                to = Term("var", f"__step{self.hidden}")
            else:
                to = o
            sides = [("triple", to, p, at) if back else ("triple", at, p, to) for p, back in step]
            out.append(sides[0] if len(sides) == 1 else ("union", [Group([x]) for x in sides]))
            at = to
        return out

    # expressions: ("term", Term) or (operator, operands..)
    def either(self) -> tuple:
        x = self.both()
        while self.take("||"):
            x = ("||", x, self.both())
        return x

    def both(self) -> tuple:
        x = self.relation()
        while self.take("&&"):
            x = ("&&", x, self.relation())
        return x

    def relation(self) -> tuple:
        x = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return (op, x, self.sum())
        return x

    def sum(self) -> tuple:
        x = self.product()
        while self.peek("+", "-"):
            x = (self.next()[1], x, self.product())
        return x

    def product(self) -> tuple:
        x = self.single()
        while self.peek("*", "/"):
            x = (self.next()[1], x, self.single())
        return x

    def single(self) -> tuple:
        if self.take("!"):
            return ("!", self.single())
        if self.take("("):
            x = self.either()
            self.need(")")
            return x
        kind, word = self.t[self.i] if self.i < len(self.t) else ("", "")
        if self.take("NOT"):
            self.need("EXISTS")
            return ("EXISTS", self.group(), False)
        if self.take("EXISTS"):
            return ("EXISTS", self.group(), True)
        if kind == "word" and word.lower() not in ("true", "false", "a"):
            self.i += 1
            self.need("(")
            args: list = []
            if word.upper() in _AGGREGATES:
                distinct = self.take("DISTINCT")
                if self.take("*"):
                    args.append(("*",))
                else:
                    args.append(self.either())
                self.need(")")
                return (word.upper(), args[0], distinct)
            while not self.take(")"):
                args.append(self.either())
                self.take(",")
            return (word.upper(), *args)
        return ("term", self.term())


def parse(query: str) -> Query:
    return _Parser(query).query()


_AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE")
_NUMERIC = ("COUNT", "SUM", "AVG", "+", "-", "*", "/", "YEAR", "MONTH", "DAY", "STRLEN", "ABS")
_TEXT = {"LCASE": F.lower, "UCASE": F.upper, "STR": lambda x: x, "CONTAINS": lambda x, y: x.contains(y), "STRSTARTS": lambda x, y: x.startswith(y), "STRENDS": lambda x, y: x.endswith(y), "STRLEN": F.length, "CONCAT": F.concat, "COALESCE": F.coalesce}


def _is_number(e: tuple) -> bool:
    return e[0] in _NUMERIC or e[0] == "term" and e[1].kind == "number"


def _value(e: tuple, has: set[str], number: bool = False) -> Column:
    op, *args = e
    if op == "term":
        t = args[0]
        if t.kind == "var":
            x = F.col(f"`{t.value}`") if t.value in has else F.lit(None).cast("string")
            return x.try_cast("double") if number else x
        return F.lit(float(t.value)) if t.kind == "number" else F.lit(t.value)
    if op in ("||", "&&"):
        a, b = (_value(x, has) for x in args)
        return a | b if op == "||" else a & b
    if op == "!":
        return ~_value(args[0], has)
    if op in ("=", "!=", "<", ">", "<=", ">="):
        n = any(map(_is_number, args))
        a, b = (_value(x, has, n) for x in args)
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if op in ("+", "-", "*", "/"):
        a, b = (_value(x, has, True) for x in args)
        return {"+": a + b, "-": a - b, "*": a * b}[op] if op != "/" else F.try_divide(a, b)
    if op in ("YEAR", "MONTH", "DAY"):
        return {"YEAR": F.year, "MONTH": F.month, "DAY": F.day}[op](F.try_to_timestamp(_value(args[0], has))).cast("double")
    if op in _AGGREGATES:
        inner, distinct = args
        if inner == ("*",):
            return F.count("*")
        x = _value(inner, has, op in ("SUM", "AVG"))
        if op == "COUNT":
            return F.count_distinct(x) if distinct else F.count(x)
        if op == "SUM":
            return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0.0))
        return {"AVG": F.avg, "MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[op](x)
    if op == "IF":
        return F.when(_value(args[0], has), _value(args[1], has)).otherwise(_value(args[2], has))
    if op == "EXISTS":
        raise SparqlError("EXISTS only as a filter of its own, or joined to others by &&")
    if op == "ABS":
        return F.abs(_value(args[0], has, True))
    if op == "BOUND":
        return _value(args[0], has).isNotNull()
    if op == "REGEX":
        if any(a[0] != "term" or a[1].kind == "var" for a in args[1:]):
            raise SparqlError("REGEX needs a constant pattern")
        flags = args[2][1].value if len(args) > 2 else ""
        return _value(args[0], has).rlike((f"(?{flags})" if flags else "") + args[1][1].value)
    if op in _TEXT:
        return _TEXT[op](*(_value(x, has) for x in args))
    raise SparqlError(f"no such function: {op}")


def _has_aggregate(e: object) -> bool:
    return isinstance(e, tuple) and bool(e) and (e[0] in _AGGREGATES or any(_has_aggregate(x) for x in e[1:]))


@dataclass
class _Bound:
    df: DataFrame
    names: set[str]
    maybe: set[str]  # may be null


class Compiler:
    def __init__(self, triples: DataFrame, keys: tuple[str, ...] = ()):
        self.triples, self.keys = triples, list(keys)

    def pattern(self, s: Term, p: Term, o: Term) -> _Bound:
        df, columns, seen = self.triples, [], {}
        for c, t in zip("spo", (s, p, o)):
            if t.kind != "var":
                df = df.filter(F.col(c) == t.value)
            elif t.value in seen:
                df = df.filter(F.col(c) == F.col(seen[t.value]))
            else:
                seen[t.value] = c
        columns = [F.col(c).alias(v) for v, c in seen.items()]
        return _Bound(df.select(*self.keys, *columns), set(seen), set())

    def join(self, a: _Bound | None, b: _Bound, how: str = "inner", condition: tuple | None = None) -> _Bound:
        if a is None:
            return b
        shared = sorted(a.names & b.names)
        on = [*self.keys, *shared]
        if not shared and not self.keys:
            df = a.df.crossJoin(b.df) if how == "inner" else a.df.join(b.df, F.lit(True) if condition is None else _value(condition, a.names | b.names), "left")
            return _Bound(df, a.names | b.names, a.maybe | b.maybe | (b.names if how == "left" else set()))
        if condition is None and not (a.maybe | b.maybe) & set(shared):
            df = a.df.join(b.df, on, how)
        else:  # an unbound variable is compatible with any value
            r = b.df.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in b.df.columns))
            test = lambda c: (F.col(f"`{c}`") == F.col(f"`__{c}`")) | ((F.col(f"`{c}`").isNull() | F.col(f"`__{c}`").isNull()) if c in a.maybe | b.maybe else F.lit(False))
            cond = reduce(lambda x, y: x & y, map(test, on))
            joined_names = {c for c in a.df.columns}
            if condition is not None:
                right_only = b.names - a.names
                renamed = b.df.select(*(F.col(f"`{c}`").alias(c if c in right_only else f"__{c}") for c in b.df.columns))
                joined = a.df.join(renamed, cond & F.coalesce(_value(condition, a.names | b.names), F.lit(False)), how)
                keep = [F.col(f"`{c}`") if c not in shared or c not in a.maybe else F.coalesce(F.col(f"`{c}`"), F.col(f"`__{c}`")).alias(c) for c in a.df.columns]
                df = joined.select(*keep, *(F.col(f"`{c}`") for c in b.df.columns if c in right_only))
            else:
                joined = a.df.join(r, cond, how)
                own = [F.coalesce(F.col(f"`{c}`"), F.col(f"`__{c}`")).alias(c) if c in on else F.col(f"`{c}`") for c in a.df.columns]
                df = joined.select(*own, *(F.col(f"`__{c}`").alias(c) for c in b.df.columns if c not in joined_names))
        return _Bound(df, a.names | b.names, a.maybe | b.maybe | (b.names - a.names if how == "left" else set()))

    def connected(self, parts: list[tuple]) -> list[tuple]:
        """Triples that stand together, each after one that it shares a variable with if that can be."""
        out: list[tuple] = []
        known: set[str] = set()
        run: list[tuple] = []

        def names(part: tuple) -> set[str]:
            return {t.value for t in part[1:] if t.kind == "var"}

        def settle() -> None:
            nonlocal known
            while run:
                at = next((k for k, x in enumerate(run) if names(x) & known), 0)
                out.append(run.pop(at))
                known |= names(out[-1])

        for part in parts:
            if part[0] == "triple":
                run.append(part)
            elif part[0] == "filter":
                out.append(part)
            else:
                settle()
                out.append(part)
                if part[0] == "values":
                    known |= set(part[1])
                elif part[0] == "bind":
                    known.add(part[2])
                elif part[0] in ("union", "optional"):
                    for g in part[1] if part[0] == "union" else [part[1]]:
                        known |= {n for x in g.parts if x[0] == "triple" for n in names(x)}
        settle()
        return out

    def unit(self) -> _Bound:
        """One row without a variable, or one a key."""
        if self.keys:
            return _Bound(self.triples.select(*self.keys).distinct(), set(), set())
        return _Bound(self.triples.sparkSession.range(1).select(), set(), set())

    def tested(self, b: _Bound, g: Group, there: bool) -> _Bound:
        """Rows of b with, or without, a solution of the group that agrees with them."""
        side, inner = self.group(g)
        if side is None:
            raise SparqlError("an empty group has no rows to look at")
        shared = sorted(b.names & side.names)
        other = side.df.select(*(F.col(f"`{c}`").alias(f"__{c}" if c in shared or c in self.keys else c) for c in side.df.columns))
        same = [F.col(f"`{c}`") == F.col(f"`__{c}`") for c in [*self.keys, *shared]]
        tests = [_value(x, b.names | side.names) for x in inner]
        on = reduce(lambda x, y: x & y, [*same, *tests], F.lit(True))
        return _Bound(b.df.join(other, on, "left_semi" if there else "left_anti"), b.names, b.maybe)

    def group(self, g: Group) -> tuple[_Bound | None, list[tuple]]:
        out, filters = None, []
        for part in self.connected(g.parts):
            if part[0] == "bind":
                out = out or self.unit()
                value = _value(part[1], out.names)
                if _is_number(part[1]):
                    value = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
                out = _Bound(out.df.withColumn(part[2], value.cast("string")), out.names | {part[2]}, out.maybe | {part[2]})
            elif part[0] == "values":
                if self.keys:
                    raise SparqlError("VALUES in a question asked of each document")
                rows = self.triples.sparkSession.createDataFrame(part[2], ", ".join(f"`{n}` string" for n in part[1]))
                out = self.join(out, _Bound(rows, set(part[1]), {n for k, n in enumerate(part[1]) if any(r[k] is None for r in part[2])}))
            elif part[0] == "minus":
                if out is not None:
                    side = self.filtered(part[1])
                    if side.names & out.names:
                        out = _Bound(out.df.join(side.df.select(*self.keys, *(F.col(f"`{n}`") for n in sorted(side.names & out.names))).distinct(), [*self.keys, *sorted(side.names & out.names)], "left_anti"), out.names, out.maybe)
            elif part[0] == "triple":
                out = self.join(out, self.pattern(*part[1:]))
            elif part[0] == "filter":
                filters.append(part[1])
            elif part[0] == "union":
                sides = [self.filtered(x) for x in part[1]]
                names = sorted(set().union(*(s.names for s in sides)))
                maybe = set().union(*(s.maybe for s in sides)) | {n for n in names if any(n not in s.names for s in sides)}
                same = [s.df.select(*self.keys, *(F.col(f"`{n}`") if n in s.names else F.lit(None).cast("string").alias(n) for n in names)) for s in sides]
                out = self.join(out, _Bound(reduce(DataFrame.unionByName, same), set(names), maybe))
            else:
                side, inner = self.group(part[1])
                out = self.join(out or self.unit(), side, "left", reduce(lambda a, b: ("&&", a, b), inner) if inner else None)
        return out, filters

    def filtered(self, g: Group) -> _Bound:
        b, filters = self.group(g)
        if b is None:
            raise SparqlError("an empty group has no rows to look at")
        while filters:
            f = filters.pop(0)
            if f[0] == "&&":
                filters = [*f[1:], *filters]
            elif f[0] == "EXISTS":
                b = self.tested(b, f[1], f[2])
            elif f[0] == "!" and f[1][0] == "EXISTS":
                b = self.tested(b, f[1][1], not f[1][2])
            else:
                b = _Bound(b.df.filter(_value(f, b.names)), b.names, b.maybe)
        return b

    def run(self, q: Query) -> DataFrame:
        b = self.filtered(q.where)
        if q.by is not None or any(_has_aggregate(e) for e in q.computed.values()):
            by = q.by or []
            made = [_value(e, b.names).alias(n) for n, e in q.computed.items()]
            tests = [_value(e, b.names).alias(f"__having{k}") for k, e in enumerate(q.having)]
            df = b.df.groupBy(*self.keys, *(F.col(f"`{n}`") for n in by)).agg(*made, *tests) if made or tests else b.df.select(*self.keys, *(F.col(f"`{n}`") for n in by)).distinct()
            for k in range(len(tests)):
                df = df.filter(F.col(f"__having{k}"))
            b = _Bound(df, set(by) | set(q.computed), set())
        else:
            df = b.df
            for n, e in q.computed.items():
                df = df.withColumn(n, _value(e, b.names))
            b = _Bound(df, b.names | set(q.computed), b.maybe)
        names = sorted(n for n in b.names if not n.startswith("__step")) if q.names is None else q.names
        df = b.df
        sort = [x.desc() if down else x.asc() for x, (_, down) in zip((_value(e, b.names) for e, _ in q.order), q.order)]
        chosen = [*self.keys, *(F.col(f"`{n}`") if n in b.names else F.lit(None).cast("string").alias(n) for n in names)]
        if q.distinct:  # what isn't selected can't order distinct rows
            df = df.select(*chosen).distinct()
            df = df.orderBy(*sort) if sort else df
        else:
            df = (df.orderBy(*sort) if sort else df).select(*chosen)
        if q.offset:
            df = df.offset(q.offset)
        return df if q.limit is None else df.limit(q.limit)


def select(triples: DataFrame, query: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a SELECT query over (s, p, o), variables as columns [DOM15]."""
    q = parse(query)
    if q.form != "select":
        raise SparqlError("not a SELECT query")
    return Compiler(triples, keys).run(q)


def ask(triples: DataFrame, query: str) -> bool:
    """Whether an ASK query has any solution; stops at the first [DOM16]."""
    q = parse(query)
    if q.form != "ask":
        raise SparqlError("not an ASK query")
    return not Compiler(triples).filtered(q.where).df.isEmpty()


def ask_each(triples: DataFrame, subjects: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """(key, answer): the question asked of each document's own triples; no for documents without any."""
    q = parse(query)
    if q.form != "ask":
        raise SparqlError("not an ASK query")
    yes = Compiler(triples, (key,)).filtered(q.where).df.select(key).distinct().withColumn("answer", F.lit(True))
    return subjects.select(key).distinct().join(yes, key, "left").select(key, F.coalesce("answer", F.lit(False)).alias("answer"))
