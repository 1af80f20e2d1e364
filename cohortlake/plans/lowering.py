"""Scripts to DataFrame expressions.

each_row becomes a filter, windows over one partitioning by id, and pushes; each_row inside another becomes
a join with the customer's other rows, on id and whatever the condition holds equal. Per-customer expressions
become one aggregation by id (Grouped), or windows of which one row per customer is kept. What has no such
form raises Unsupported, and the script runs on the interpreter, one customer per group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlake.functions import nil, scalars
from cohortlake.operators import inline, rows
from cohortlake.plans.interpreter import stamp_of
from cohortlake.plans.syntax import Node, Script, walk

_CALLS = {"bucket", "round", "trunc", "fix", "int", "float", "str", "len", "iso8601_to_stamp", "date_day", "list", "set", "url_decode", "keys", "range"}
_META = ("row_count", "first_stamp", "last_stamp", "session_count")


class Unsupported(Exception):
    """No expression form; the message says what."""


def _plain_list(n: Node) -> list | None:
    """The values of a list of plain values."""
    return [p.value for p in n.parts] if n.kind == "list" and n.parts and all(p.kind == "lit" and p.value is not None for p in n.parts) else None


def needs_places(script: Script) -> bool:
    """Whether rows must be numbered; else any unique number of a row will do, and no sort is needed."""
    said = list(walk(script.body))
    within = any(x.kind == "each" for n in said if n.kind == "each" for x in walk(n.parts[1]))
    return within or says_places(script)


def says_places(script: Script) -> bool:
    """Whether the script itself asks for places of rows or their order."""
    said = list(walk(script.body))
    return any(a.kind == "value" for a in script.select) or any(
        n.kind in ("return", "exit") or n.kind in ("name", "call") and n.value in ("cursor", "get_row") or n.kind == "inline" and n.value == "row" or n.kind == "each" and "from" in dict(n.value) for n in said
    )


def _parts(n: Node) -> list[Node]:
    """What && holds together."""
    return [x for p in n.parts for x in _parts(p)] if n.kind == "logic" and n.value == "&&" else [n]


@dataclass
class Push:
    frame: DataFrame
    keys: list[Column]


def needs(script: Script, names: set[str]) -> set[str]:
    """Which of the names the script or its select mentions."""
    said = {n.value for n in walk(script.body) if n.kind in ("name", "filter") and isinstance(n.value, str)}
    return names & (said | {a.prop for a in script.select} | {a.key for a in script.select if a.key})


class Lowering:
    def __init__(self, script: Script, frame: DataFrame, *, now: int, compat_nil_order: bool = False):
        if compat_nil_order:
            raise Unsupported("raw order of nil")
        self.script, self.frame, self.now = script, frame, now
        self.whole, self.outer = frame, []
        self.columns = set(frame.columns)
        self.vars: dict[str, Column] = {}
        self.made = 0
        # a place only tells rows of one push apart, so any unique number will do
        self.once = not says_places(script) and sum(n.kind == "tally" for n in walk(script.body)) == 1
        self.pushes: list[Push] = []
        self.returns: list[tuple[Column, Column]] = []
        self.bounds: tuple[Column | float, Column | float] = (-math.inf, math.inf)

    def held(self, value: Column) -> Column:
        """value as a column of the frame, so that later filters do not change its window."""
        name = f"_w{self.made}"
        self.made += 1
        self.frame = self.frame.withColumn(name, value)
        return F.col(name)

    def kind(self, c: Column) -> T.DataType:
        return self.frame.select(c.alias("x")).schema["x"].dataType

    # statements of the whole script

    def run(self) -> Lowering:
        self.top(self.script.body, F.lit(True))
        return self

    def top(self, body: list[Node], given: Column) -> None:
        for s in body:
            if s.kind == "each":
                self.each(s, given)
            elif s.kind == "assign" and s.parts[0].kind == "name" and s.parts[0].value not in self.columns:
                self.vars[s.parts[0].value] = self.held(self.expr(s.parts[1], top=True))
            elif s.kind == "if":
                test = self.held(self.truth(s.parts[0], top=True))
                self.top(s.parts[1], given & test)
                self.top(s.parts[2], given & ~test)
            elif s.kind == "return":
                value = F.lit(True) if s.parts[0] is None else self.expr(s.parts[0], top=True)
                self.returns.append((given, self.held(value)))
            elif s.kind == "do" and s.parts[0].kind == "call" and s.parts[0].value == "log":
                continue
            else:
                raise Unsupported(f"line {s.line}: {s.kind} outside each_row")

    def each(self, s: Node, given: Column) -> None:
        opts, (where, body) = dict(s.value), s.parts
        if "continue" in opts or "next" in opts:
            raise Unsupported(f"line {s.line}: a start at another row")
        outer, self.bounds = self.bounds, self.scope(s.value)
        kept = self.truth(where) & given & self.in_bounds()
        back = "reverse" in opts
        if "from" in opts:
            at = self.expr(opts["from"][0])
            kept = kept & ((F.col("rn") <= at) if back else (F.col("rn") >= at))
        if "limit" in opts:
            most = opts["limit"][0]
            if most.kind != "lit":
                raise Unsupported(f"line {s.line}: a computed limit")
            kept = self.held(kept)
            # first matches of each customer: rows that match come first in the window
            order = [F.desc(k) if back else F.asc(k) for k in ("stamp", "z", "seq")]
            place = self.held(F.row_number().over(Window.partitionBy("id").orderBy(F.desc(kept), *order)))
            kept = kept & (place <= most.value)
        kept = self.held(kept)
        before = dict(self.vars)
        self.inner(body, kept)
        self.vars, self.bounds = before, outer

    def inner(self, body: list[Node], given: Column) -> Column:
        """Statements at a row; returns where the row goes on."""
        for s in body:
            if s.kind == "tally":
                keys = [self.expr(p) for p in s.parts]
                self.pushes.append(Push(self.frame.where(given), keys))
                self.last_vars = dict(self.vars)
            elif s.kind == "if":
                test = self.truth(s.parts[0])
                on = self.inner(s.parts[1], given & test)
                off = self.inner(s.parts[2], given & ~test)
                given = on | off
            elif s.kind == "continue":
                return F.lit(False)
            elif s.kind == "assign" and s.parts[0].kind == "name" and s.parts[0].value not in self.columns:
                name = s.parts[0].value
                if any(n.kind == "name" and n.value == name for n in walk(s.parts[1])) or name in self.vars:
                    raise Unsupported(f"line {s.line}: {name} is carried from row to row")
                self.vars[name] = self.expr(s.parts[1])
            elif s.kind == "for":
                self.unrolled(s, given)
            elif s.kind == "each":
                self.nested(s, given)
            elif s.kind == "return" and not self.returns and not self.outer:
                value = F.lit(True) if s.parts[0] is None else self.expr(s.parts[0])
                # the first row that gets here decides
                first = self.held(F.min(F.when(given, F.struct("rn", value.alias("v")))).over(rows.everything()))
                self.returns.append((first.isNotNull(), first["v"]))
                return F.lit(False)
            elif s.kind == "do" and s.parts[0].kind == "call" and s.parts[0].value == "log":
                continue
            else:
                raise Unsupported(f"line {s.line}: {s.kind} at a row")
        return given

    def nested(self, s: Node, given: Column) -> None:
        """each_row at a row: the rows that get here, each with its customer's rows that meet the condition. Parts of the
        condition that hold a property equal to a variable are keys; a limit takes the nearest matches of each row."""
        opts, (where, body) = dict(s.value), s.parts
        if {"from", "reverse", "forward"} & set(opts) or "next" in opts and "continue" not in opts or "limit" in opts and opts["limit"][0].kind != "lit":
            raise Unsupported(f"line {s.line}: this start or direction inside each_row")
        before, frame, bounds = dict(self.vars), self.frame, self.bounds
        lo_hi, made = self.scope(s.value), self.made
        said = {n.value for n in walk(s.parts) if n.kind in ("name", "call", "assign")}
        names = {n: self.held(v) for n, v in self.vars.items() if n in said}
        held = [x if isinstance(x, float) else self.held(x) for x in lo_hi]
        ordered = any({"limit", "continue"} & set(dict(n.value)) for n in [s, *walk(body)] if n.kind == "each")
        here, kept = f"_rn{len(self.outer)}", [*(c for c in self.frame.columns if ordered and c in self.outer), *(f"_w{k}" for k in range(made, self.made))]
        free, keys, rest = self.sorted_out(where, names)
        self.outer.append(here)
        if "next" in opts and "limit" in opts and opts["limit"][0].value == 1 and frame.columns[: len(self.whole.columns)] == self.whole.columns and len(self.outer) == 1 and held == list(lo_hi) and not keys and not rest:
            self.frame = self.following(where, given, here, kept)
            self.vars, self.bounds = names, tuple(held)
        else:
            left, self.frame = self.frame.where(given), self.whole
            right = self.whole.where(reduce(lambda a, b: a & b, [self.truth(p) for p in free], F.lit(True)))
            if keys and not ordered:
                later = {n.value for n in walk([rest, body]) if n.kind in ("name", "call")}
                done = [c for c, n in zip(kept, names, strict=False) if n not in later]
                self.frame = self.met(left, right, keys, [c for c in kept if c not in done] or kept[:1])
            else:
                rows_here = left.select(F.col("id").alias("_id"), F.col("rn").alias(here), *kept)
                self.frame, rest = rows_here.join(right, F.col("_id") == F.col("id")).drop("_id"), [where]
            self.vars, self.bounds = names, tuple(held)
            met = reduce(lambda a, b: a & b, [self.truth(p) for p in rest], self.in_bounds())
            if "continue" in opts:
                met = met & ((F.col("rn") > F.col(here)) if "next" in opts else (F.col("rn") >= F.col(here)))
            self.frame = self.frame.where(met)
            if "limit" in opts:
                order = Window.partitionBy("id", *self.outer).orderBy("rn")
                self.frame = self.frame.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= opts["limit"][0].value).drop("_n")
        self.inner(body, F.lit(True))
        self.outer.pop()
        self.frame, self.vars, self.bounds = frame, before, bounds
        self.joined = True

    def sorted_out(self, where: Node, names: dict[str, Column]) -> tuple[list[Node], list[tuple[str, Column]], list[Node]]:
        """The parts of a condition: those without variables, (property, variable) held equal, and others."""
        free, keys, rest = [], [], []
        for p in _parts(where):
            if p.kind == "filter" and set(dict(p.parts[0])) == {"is"} and dict(p.parts[0])["is"][0].value == "==":
                pair = (Node("name", p.value, (), p.line), dict(p.parts[0])["is"][1])
            else:
                pair = p.parts if p.kind == "compare" and p.value == "==" else ()
            key = next(((a.value, names[b.value]) for a, b in (pair, pair[::-1]) if a.kind == b.kind == "name" and b.value in names and a.value in set(self.whole.columns) - set(names)), None) if pair else None
            if not any(n.kind in ("name", "call") and n.value in names for n in walk(p)):
                free.append(p)
            elif key and self.whole.schema[key[0]].dataType == self.kind(key[1]):
                keys.append(key)
            else:
                rest.append(p)
        return free, keys, rest

    def following(self, where: Node, given: Column, here: str, kept: list[str]) -> DataFrame:
        """The rows that get here, each with the next row of its customer that meets a condition of its own.

        One window from the last row to the first, so a long history is not joined with itself. Each column is found
        by itself: those that nothing asks for, places among them, are not even read."""
        met = self.truth(where)
        later = rows.ordered(desc=True).rowsBetween(Window.unboundedPreceding, -1)
        found = lambda c: F.last(F.when(met, F.struct(c.alias("v"))), ignorenulls=True).over(later)
        names = [c for c in self.whole.columns if c != "id"]
        out = self.frame.where(given | met).select("id", F.col("rn").alias(here), *kept, given.alias("_on"), found(F.lit(True)).alias("_any"), *[found(F.col(c)).alias(f"_f_{c}") for c in names])
        return out.where("_on AND _any IS NOT NULL").select("id", here, *kept, *[F.col(f"_f_{c}.v").alias(c) for c in names])

    def met(self, left: DataFrame, right: DataFrame, keys: list[tuple[str, Column]], carried: list[str]) -> DataFrame:
        """Rows of both sides that have a customer and the keys in common, null with null.

        A join would deal both out by all the keys, and all it makes once more by customer. Here they are dealt out by
        customer: the left rows of a key become an array, which a window gives to the right rows of the key. The number
        of partitions is given: adaptive plans would merge them by what they read, and what they make is larger."""
        on = [f"_key{k}" for k in range(len(keys))]
        if self.once:
            right = right.drop("rn")
        mine = left.groupBy("id", *[v.alias(k) for k, (_, v) in zip(on, keys, strict=True)]).agg(F.collect_list(F.struct(*carried)).alias("_here"))
        both = right.select("*", *[F.col(c).alias(k) for k, (c, _) in zip(on, keys, strict=True)]).unionByName(mine, allowMissingColumns=True).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        given = F.first("_here", ignorenulls=True).over(Window.partitionBy("id", *on))
        out = both.select(*right.columns, F.col("_here").isNull().alias("_row"), given.alias("_here")).where("_row AND _here IS NOT NULL")
        if self.once:
            out = out.withColumn("rn", F.monotonically_increasing_id())
        return out.select(*self.whole.columns, F.explode("_here").alias("_one")).select(*self.whole.columns, *[F.col(f"_one.{c}").alias(c) for c in carried])

    joined = False

    def unrolled(self, s: Node, given: Column) -> None:
        """for over a container with pushes: one row per element."""
        over = self.expr(s.parts[0])
        if len(s.value) != 1 or not isinstance(self.kind(over), T.ArrayType) or any(n.kind in ("break", "assign", "each") for n in walk(s.parts[1])):
            raise Unsupported(f"line {s.line}: this for")
        whole, name = self.frame, f"_v{self.made}"
        self.made += 1
        self.frame = whole.withColumn("_on", given).where("_on").withColumn(name, F.explode(over))
        self.vars[s.value[0]] = F.col(name)
        self.inner(s.parts[1], F.lit(True))
        del self.vars[s.value[0]]
        self.frame = whole

    # date scopes

    def when(self, n: Node) -> Column:
        if n.kind == "lit" and isinstance(n.value, str):
            return F.lit(stamp_of(n.value))
        return scalars.millis(self.expr(n))

    def scope(self, chain) -> tuple:
        lo, hi = self.bounds
        join = lambda f, a, b: b if isinstance(a, float) else f(a, b)
        for name, args in chain:
            if name in ("within", "look_ahead", "look_back"):
                w, s = self.expr(args[0]), self.when(args[1])
                lo = join(F.greatest, lo, s if name == "look_ahead" else s - w)
                hi = join(F.least, hi, s if name == "look_back" else s + w)
            elif name == "range":
                lo, hi = join(F.greatest, lo, self.when(args[0])), join(F.least, hi, self.when(args[1]))
        return lo, hi

    def in_bounds(self, bounds: tuple | None = None) -> Column:
        lo, hi = bounds or self.bounds
        parts = ([] if isinstance(lo, float) else [F.col("stamp") >= lo]) + ([] if isinstance(hi, float) else [F.col("stamp") <= hi])
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    # expressions

    def truth(self, n: Node, top: bool = False) -> Column:
        c = self.expr(n, top)
        if n.kind in ("compare", "logic", "not", "filter"):
            return c  # never null
        kind = self.kind(c)
        return F.coalesce(c, F.lit(False)) if isinstance(kind, T.BooleanType) else nil.truthy(c, kind)

    def expr(self, n: Node, top: bool = False) -> Column:
        made = getattr(self, f"of_{n.kind}", None)
        if made is None:
            raise Unsupported(f"line {n.line}: {n.kind}")
        return made(n, top)

    def of_lit(self, n: Node, top: bool) -> Column:
        return F.lit(n.value).cast("long") if isinstance(n.value, int) and not isinstance(n.value, bool) else F.lit(n.value)

    def of_list(self, n: Node, top: bool) -> Column:
        return F.array(*[self.expr(p, top) for p in n.parts])

    def of_name(self, n: Node, top: bool) -> Column:
        name = n.value
        if name in self.vars:
            return self.vars[name]
        if name == "now":
            return F.lit(self.now).cast("long")
        if name == "cursor" and not top:
            return F.col("rn").cast("long")
        if name in _META and name in self.columns:
            return F.col(name)
        if name in self.columns:
            if top and name != "id" and f"_customer_{name}" not in self.columns:
                raise Unsupported(f"line {n.line}: the row property {name} outside each_row")
            return F.col(f"_customer_{name}") if f"_customer_{name}" in self.columns else F.col(name)
        if f"_customer_{name}" in self.columns:
            return F.col(f"_customer_{name}")
        raise Unsupported(f"line {n.line}: {name}")

    def of_not(self, n: Node, top: bool) -> Column:
        return ~self.truth(n.parts[0], top)

    def of_logic(self, n: Node, top: bool) -> Column:
        a, b = (self.truth(p, top) for p in n.parts)
        return a & b if n.value == "&&" else a | b

    def of_compare(self, n: Node, top: bool) -> Column:
        if n.value == "in" and (plain := _plain_list(n.parts[1])) is not None:
            return self.one_of(self.expr(n.parts[0], top), plain)
        return self.compared(n.value, self.expr(n.parts[0], top), self.expr(n.parts[1], top))

    def one_of(self, a: Column, values: list) -> Column:
        """A form that the scan can filter by, if the values have the column's type."""
        kind = self.kind(a)
        same = {T.StringType: str, T.LongType: int, T.DoubleType: (int, float)}.get(type(kind))
        if same is None or not all(isinstance(v, same) and not isinstance(v, bool) for v in values):
            return nil.contains(F.array(*[F.lit(v) for v in values]), a, False)
        return nil.among(a, values)

    def compared(self, op: str, a: Column, b: Column) -> Column:
        ka, kb = self.kind(a), self.kind(b)
        if op == "in":
            if not isinstance(kb, T.ArrayType):
                raise Unsupported("in without a list")
            return nil.contains(b, a, False)
        if op == "contains":
            return nil.contains(a, b, isinstance(kb, T.ArrayType)) if isinstance(ka, T.ArrayType) else F.lit(False)
        if op == "any":
            return nil.overlaps(a, b if isinstance(kb, T.ArrayType) else F.array(b)) if isinstance(ka, T.ArrayType) else F.lit(False)
        text = T.StringType()
        if ka != kb and text in (ka, kb):
            b = b.cast("string") if ka == text else scalars.to_float(b)
        if op == "==":
            return nil.equal(a, b)
        return nil.unequal(a, b) if op == "!=" else nil.ordered(op, a, b)

    def of_math(self, n: Node, top: bool) -> Column:
        a, b = (self.expr(p, top) for p in n.parts)
        ka, kb = self.kind(a), self.kind(b)
        if isinstance(ka, T.StringType) and n.value in "+-":
            return F.concat(a, F.coalesce(b.cast("string"), F.lit(""))) if n.value == "+" else scalars.remove(a, b.cast("string"))
        if isinstance(ka, T.ArrayType):
            raise Unsupported(f"line {n.line}: a growing container")
        zero = F.lit(0).cast("long")
        a, b = F.coalesce(a, zero), F.coalesce(b, zero)
        if n.value == "/":
            return scalars.divide(a, b, isinstance(ka, T.LongType) and isinstance(kb, T.LongType))
        return a + b if n.value == "+" else a - b if n.value == "-" else a * b

    def of_index(self, n: Node, top: bool) -> Column:
        box, key = (self.expr(p, top) for p in n.parts)
        kind = self.kind(box)
        if isinstance(kind, T.ArrayType):
            return scalars.at(box, key)
        if isinstance(kind, (T.StructType, T.MapType)) and n.parts[1].kind == "lit":
            return box[n.parts[1].value] if isinstance(kind, T.StructType) else F.try_element_at(box, key)
        raise Unsupported(f"line {n.line}: this subscript")

    def of_slice(self, n: Node, top: bool) -> Column:
        box, ends = self.expr(n.parts[0], top), n.parts[1:]
        if not isinstance(self.kind(box), T.StringType) or any(p is not None and p.kind != "lit" for p in ends):
            raise Unsupported(f"line {n.line}: this slice")
        return scalars.slice_text(box, *[None if p is None else p.value for p in ends])

    def of_filter(self, n: Node, top: bool) -> Column:
        opts = dict(n.parts[0])
        for kind in ("is", "is_not", "row", "ever", "never"):
            if kind not in opts:
                continue
            op, value = opts[kind][0].value, opts[kind][1]
            plain = _plain_list(value) if op == "in" else None
            met = self.one_of(F.col(n.value), plain) if plain is not None else self.compared(op, F.col(n.value), self.expr(value, top))
            if kind in ("is", "is_not", "row"):
                if top:
                    raise Unsupported(f"line {n.line}: is outside each_row")
                yes = met
                return ~yes if kind == "is_not" else yes
            if {"next", "continue"} & set(opts) or self.outer:
                raise Unsupported(f"line {n.line}: a start at another row")
            lo_hi = self.scope(n.parts[0])
            if not top and any(x.kind in ("name", "filter") and x.value in self.columns for _, args in n.parts[0] for x in walk(args)):
                raise Unsupported(f"line {n.line}: a scope around each row")
            met = self.held(rows.ever(met, scope=self.in_bounds(lo_hi)))
            return met if kind == "ever" else ~met
        raise Unsupported(f"line {n.line}: {n.value} without is, ever or never")

    def of_inline(self, n: Node, top: bool) -> Column:
        value, chain, where = n.parts
        opts = dict(chain)
        if {"continue", "next", "from", "limit"} & set(opts) or self.outer:
            raise Unsupported(f"line {n.line}: a start or limit of an inline aggregate")
        if not top and any(x.kind == "name" and x.value in self.columns for _, args in chain for x in walk(args)):
            raise Unsupported(f"line {n.line}: a scope around each row")
        met = self.truth(where) & self.in_bounds(self.scope(chain))
        return self.held(inline.windowed(n.value, None if value is None else self.expr(value), met, rows.everything(), reverse="reverse" in opts))

    def of_call(self, n: Node, top: bool) -> Column:
        name = n.value
        if name in ("now", "cursor", *_META) and not n.parts:
            return self.of_name(Node("name", name, (), n.line), top)
        args = [self.expr(p, top) for p in n.parts]
        number = lambda k, default=None: n.parts[k].value if len(n.parts) > k and n.parts[k].kind == "lit" else default
        if name.startswith("get_") and name != "get_row":
            return scalars.date_part(name[4:], args[0])
        if name.startswith("start_of_") or name == "date_day":
            return scalars.start_of("day" if name == "date_day" else name[9:], args[0])
        if name.startswith("to_"):
            return scalars.to_span(name[3:], args[0])
        if name not in _CALLS | {"__find", "__rfind", "__strip", "__split"} or name in ("bucket", "fix") and number(1) is None or name == "round" and len(args) > 1 and number(1) is None:
            raise Unsupported(f"line {n.line}: {name}()")
        if name == "len":
            kind = self.kind(args[0])
            return F.coalesce((F.length(args[0]) if isinstance(kind, T.StringType) else F.size(args[0])).cast("long"), F.lit(0).cast("long"))
        if name in ("__find", "__rfind", "__strip", "__split"):
            if not isinstance(self.kind(args[0]), T.StringType) or len(args) > 2:
                raise Unsupported(f"line {n.line}: {name} of this")
            return {"__find": lambda: scalars.find(*args), "__rfind": lambda: scalars.rfind(*args), "__strip": lambda: scalars.strip(args[0]), "__split": lambda: scalars.split(*args)}[name]()
        made = {"bucket": lambda: scalars.bucket(args[0], number(1)), "round": lambda: scalars.round_(args[0], number(1, 0)), "trunc": lambda: scalars.trunc(args[0]), "fix": lambda: scalars.fix(args[0], number(1)), "int": lambda: scalars.to_int(args[0]), "float": lambda: scalars.to_float(args[0]), "str": lambda: args[0].cast("string"), "iso8601_to_stamp": lambda: scalars.iso8601_to_stamp(args[0]), "list": lambda: F.array(*args), "set": lambda: F.array_distinct(F.array(*args)), "url_decode": lambda: scalars.url_decode(args[0]), "keys": lambda: F.map_keys(args[0]), "range": lambda: F.sequence(*args)}
        return made[name]()


class Grouped(Lowering):
    """Scripts without each_row, on one aggregation by id (and further keys): inline aggregates, ever and never become
    aggregates with map-side partial sums, and what is made of them is computed from one row per customer."""

    def __init__(self, script: Script, frame: DataFrame, *, now: int, keys: tuple[str, ...] = ("id",), prefix: str = "_a"):
        super().__init__(script, frame, now=now)
        self.keys, self.prefix, self.aggregates, self.at_row = keys, prefix, {}, False

    def grouped(self) -> DataFrame:
        """One row for each key with all aggregates so far."""
        if not self.aggregates:
            return self.whole.select(*self.keys).distinct()
        return self.whole.groupBy(*self.keys).agg(*[c.alias(n) for n, c in self.aggregates.items()])

    def kind(self, c: Column) -> T.DataType:
        return (self.whole if self.at_row else self.grouped()).select(c.alias("x")).schema["x"].dataType

    def held(self, value: Column) -> Column:
        return value

    def each(self, s: Node, given: Column) -> None:
        raise Unsupported(f"line {s.line}: rows in turn")

    def over_rows(self, make) -> Column:
        """The aggregate that make() gives at the customer's rows, as a column of grouped()."""
        if self.at_row:
            raise Unsupported("an aggregate inside another")
        self.at_row = True
        try:
            made = make()
        finally:
            self.at_row = False
        name = f"{self.prefix}{len(self.aggregates)}"
        self.aggregates[name] = made
        return F.col(name)

    def of_name(self, n: Node, top: bool) -> Column:
        name = n.value
        if name in self.vars and self.at_row:
            raise Unsupported(f"line {n.line}: {name} inside an aggregate")
        if name in self.vars or name == "now" or self.at_row:
            return super().of_name(n, top)
        if f"_customer_{name}" in self.columns:
            return self.over_rows(lambda: F.any_value(f"_customer_{name}"))
        if name == "row_count":
            return self.over_rows(lambda: F.count(F.lit(1)))
        if name in ("first_stamp", "last_stamp"):
            return self.over_rows(lambda: (F.min if name == "first_stamp" else F.max)("stamp"))
        raise Unsupported(f"line {n.line}: {name} of a customer")

    def of_inline(self, n: Node, top: bool) -> Column:
        value, chain, where = n.parts
        opts = dict(chain)
        if {"continue", "next", "from", "limit"} & set(opts):
            raise Unsupported(f"line {n.line}: a start or limit of an inline aggregate")
        scope = self.scope(chain)

        def make() -> Column:
            met = self.truth(where) & self.in_bounds(scope)
            return inline.aggregate(n.value, None if value is None else self.expr(value), met, reverse="reverse" in opts)

        return self.over_rows(make)

    def of_filter(self, n: Node, top: bool) -> Column:
        opts = dict(n.parts[0])
        kind = next((k for k in ("ever", "never") if k in opts), None)
        if self.at_row or kind is None or {"next", "continue"} & set(opts):
            if kind is not None or not self.at_row:
                raise Unsupported(f"line {n.line}: this filter of a customer")
            return super().of_filter(n, top)
        scope, (op, value) = self.scope(n.parts[0]), (opts[kind][0].value, opts[kind][1])

        def make() -> Column:
            plain = _plain_list(value) if op == "in" else None
            met = self.one_of(F.col(n.value), plain) if plain is not None else self.compared(op, F.col(n.value), self.expr(value))
            return F.max(F.coalesce(met & self.in_bounds(scope), F.lit(False)))

        met = self.over_rows(make)
        return met if kind == "ever" else ~met

    def value(self, kind: T.DataType) -> Column:
        """What the script returns, in a type."""
        if not self.returns:
            raise Unsupported("no return")
        out: Column = F.lit(None)
        for given, v in reversed(self.returns):
            out = F.when(given, v).otherwise(out)
        return out.cast(kind)


def per_value(script: Script, prop: str) -> bool:
    """Whether the script is one aggregate of the rows where prop is each_value, which is nil without such rows."""
    if len(script.body) != 1 or script.body[0].kind != "return" or script.body[0].parts[0] is None:
        return False
    n = script.body[0].parts[0]
    if n.kind != "inline" or n.value not in ("sum", "min", "max", "count", "dcount"):
        return False

    def held(w: Node) -> bool:
        if w.kind == "logic" and w.value == "&&":
            return any(held(p) for p in w.parts)
        if w.kind == "filter" and w.value == prop:
            given = dict(w.parts[0]).get("is")
            return given is not None and given[0].value == "==" and given[1].kind == "name" and given[1].value == "each_value"
        return w.kind == "compare" and w.value == "==" and {(p.kind, p.value) for p in w.parts} == {("name", prop), ("name", "each_value")}

    return held(n.parts[2])
