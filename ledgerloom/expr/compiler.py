"""Compiles a parsed formula to a column and the condition under which it is defined."""

from __future__ import annotations

import ast
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import ArgumentError, FormulaSyntaxError, TypeMismatchError, UnknownFunctionError, UnknownVariableError, did_you_mean
from ledgerloom.expr import values as V
from ledgerloom.expr.values import BOOL, DOUBLE, LONG, STRING, Val, both, carry, either, number
from ledgerloom.functions.arrays import elements, field, item, mapped
from ledgerloom.functions.logic import chosen, equal
from ledgerloom.functions.registry import CONSTANTS, Function, load


class Compiler:
    """env: variables as values. functions: name to Function (the registry by default)."""

    def __init__(self, env: Mapping[str, Val], functions: Mapping[str, Function] | None = None):
        self.env, self.functions = env, functions if functions is not None else load()

    def compile(self, tree: ast.expr) -> Val:
        return self._do(tree, {})

    def _do(self, node: ast.expr, bound: dict[str, Val]) -> Val:
        build = getattr(self, f"_{type(node).__name__.lower()}", None)
        if build is None:
            raise FormulaSyntaxError(f"{type(node).__name__} can't be compiled")
        return build(node, bound)

    # --- leaves

    def _constant(self, node: ast.Constant, bound) -> Val:
        return V.lit(node.value)

    def _name(self, node: ast.Name, bound) -> Val:
        if node.id in bound:
            return bound[node.id]
        if node.id in self.env:
            return self.env[node.id]
        if node.id in CONSTANTS and not isinstance(CONSTANTS[node.id], dict):
            return V.lit(CONSTANTS[node.id])
        raise UnknownVariableError(f"unknown variable {node.id!r}{did_you_mean(node.id, self.env)}")

    def _joinedstr(self, node: ast.JoinedStr, bound) -> Val:
        parts = [self._do(p, bound) for p in node.values]
        return carry(parts, F.concat(*[F.coalesce(V.text(p), F.lit("None")) for p in parts]) if parts else F.lit(""), STRING)

    def _formattedvalue(self, node: ast.FormattedValue, bound) -> Val:
        v = self._do(node.value, bound)
        if node.format_spec is None:
            return carry([v], F.coalesce(V.text(v), F.lit("None")), STRING)
        spec = "".join(p.value for p in node.format_spec.values if isinstance(p, ast.Constant))
        n = number(v)
        if spec.startswith(",") and spec.endswith("f"):
            return carry([n], F.format_number(n.col, int(spec[2:-1] or 6)), STRING)
        if spec.startswith(".") and spec.endswith("f"):
            return carry([n], F.printf(F.lit(f"%{spec}"), F.bround(n.col.cast("double"), int(spec[1:-1]))), STRING)
        if spec.endswith("d"):
            return carry([n], F.printf(F.lit(f"%{spec}"), n.col.cast("long")), STRING)
        raise FormulaSyntaxError(f"format {spec!r} isn't supported")

    # --- operators

    def _unaryop(self, node: ast.UnaryOp, bound) -> Val:
        v = self._do(node.operand, bound)
        if isinstance(node.op, ast.Not):
            return carry([v], ~V.truthy(v), BOOL)
        if v.is_const and isinstance(v.const, (int, float)) and not isinstance(v.const, bool) and not isinstance(node.op, ast.Invert):
            return V.lit(-v.const if isinstance(node.op, ast.USub) else v.const)
        n = number(v)
        if isinstance(node.op, ast.Invert):
            raise FormulaSyntaxError("~ isn't supported")
        return carry([n], -n.col if isinstance(node.op, ast.USub) else n.col, n.dtype)

    def _binop(self, node: ast.BinOp, bound) -> Val:
        a, b = self._do(node.left, bound), self._do(node.right, bound)
        op = type(node.op)
        if op is ast.Add and V.is_str(a.dtype) and V.is_str(b.dtype):
            return carry([a, b], F.concat(a.col, b.col), STRING, a.col.isNotNull(), b.col.isNotNull())
        if op is ast.Add and V.is_array(a.dtype) and V.is_array(b.dtype):
            t = V.unify(a.dtype, b.dtype)
            return carry([a, b], F.concat(a.col.cast(t), b.col.cast(t)), t)
        if op is ast.Mult and V.is_str(a.dtype) and V.is_int(b.dtype):
            return carry([a, b], F.repeat(a.col, b.col.cast("int")), STRING, a.col.isNotNull(), b.col.isNotNull())
        if op is ast.Sub and V.is_date(a.dtype) and V.is_date(b.dtype):
            return carry([a, b], F.datediff(a.col, b.col).cast("long"), LONG, a.col.isNotNull(), b.col.isNotNull())
        x, y = number(a), number(b)
        whole = V.is_int(x.dtype) and V.is_int(y.dtype)
        l, r = (x.col, y.col) if whole else (x.col.cast("double") if V.is_int(x.dtype) else x.col, y.col.cast("double") if V.is_int(y.dtype) else y.col)
        if op in (ast.Add, ast.Sub, ast.Mult):
            if whole:
                col = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[op](l, r)
            else:
                col = l + r if op is ast.Add else l - r if op is ast.Sub else l * r
            return carry([x, y], col, LONG if whole else DOUBLE)
        if op is ast.Pow:
            return self.functions["power"]([a, b])
        if op not in (ast.Div, ast.FloorDiv, ast.Mod):
            raise FormulaSyntaxError(f"operator {op.__name__} isn't supported")
        if y.is_const and y.const != 0:
            zero, safe = None, r
        else:
            zero, safe = r == 0, F.nullif(r, F.lit(0).cast(LONG if whole else DOUBLE))
        if op is ast.Div:
            col, dtype = x.col.cast("double") / safe.cast("double"), DOUBLE
        elif op is ast.FloorDiv:
            remainder = (l % safe + safe) % safe
            col, dtype = ((l - remainder) / safe).cast("long") if whole else F.floor(l / safe).cast("double"), LONG if whole else DOUBLE
        else:
            col, dtype = (l % safe + safe) % safe, LONG if whole else DOUBLE
        clean = [Val(v.col, v.dtype, v.ok, v.zero) for v in (x, y)]
        if zero is None:
            return carry(clean, col, dtype)
        defined = both(x.ok, y.ok)
        happened = zero if defined is None else defined & zero
        return Val(col, dtype, both(x.ok, y.ok, ~zero), either(x.zero, y.zero, happened))

    def _boolop(self, node: ast.BoolOp, bound) -> Val:
        parts = [self._do(v, bound) for v in node.values]
        if all(V.is_bool(p.dtype) for p in parts) and all(p.ok is None for p in parts):
            fold = (lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b)
            return carry(parts, reduce(fold, map(V.truthy, parts)), BOOL)
        out = parts[-1]
        for p in reversed(parts[:-1]):
            out = chosen([(V.truthy(p), out)], p, True, [p]) if isinstance(node.op, ast.And) else chosen([(V.truthy(p), p)], out, True, [p])
        return out

    def _compare(self, node: ast.Compare, bound) -> Val:
        values = [self._do(v, bound) for v in (node.left, *node.comparators)]
        tests = [self._one(op, a, b) for op, a, b in zip(node.ops, values[:-1], values[1:], strict=True)]
        return carry(tests, reduce(lambda a, b: a & b, (t.col for t in tests)), BOOL)

    def _one(self, op: ast.cmpop, a: Val, b: Val) -> Val:
        if isinstance(op, (ast.Eq, ast.Is)):
            return carry([a, b], equal(a, b), BOOL)
        if isinstance(op, (ast.NotEq, ast.IsNot)):
            return carry([a, b], ~equal(a, b), BOOL)
        if isinstance(op, (ast.In, ast.NotIn)):
            if V.is_str(b.dtype):
                inside = F.coalesce(F.contains(b.col, V.text(a)), F.lit(False))
            elif isinstance(b.dtype, T.MapType):
                inside = F.coalesce(F.map_contains_key(b.col, a.col.cast(b.dtype.keyType)), F.lit(False))
            else:
                e = elements(b)
                inside = F.exists(e.col, lambda x: equal(item(e, x), a))
            return carry([a, b], inside if isinstance(op, ast.In) else ~inside, BOOL)
        build = {ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y}[type(op)]
        num = lambda t: V.is_num(t) or V.is_bool(t)
        if num(a.dtype) and num(b.dtype):
            x, y = number(a), number(b)
            return carry([Val(x.col, x.dtype, x.ok, x.zero), Val(y.col, y.dtype, y.ok, y.zero)], F.coalesce(build(x.col, y.col), F.lit(False)), BOOL)
        if (V.is_str(a.dtype) and V.is_str(b.dtype)) or (V.is_date(a.dtype) and V.is_date(b.dtype)):
            return carry([a, b], F.coalesce(build(a.col, b.col), F.lit(False)), BOOL, a.col.isNotNull(), b.col.isNotNull())
        if {V.is_date(a.dtype), V.is_date(b.dtype)} == {True, False} and (V.is_str(a.dtype) or V.is_str(b.dtype)):
            d = lambda v: v.col.cast("timestamp") if V.is_date(v.dtype) else v.col.try_cast("timestamp")
            return carry([a, b], F.coalesce(build(d(a), d(b)), F.lit(False)), BOOL, d(a).isNotNull(), d(b).isNotNull())
        return carry([a, b], F.lit(False), BOOL, F.lit(False))

    def _ifexp(self, node: ast.IfExp, bound) -> Val:
        c = self._do(node.test, bound)
        return chosen([(V.truthy(c), self._do(node.body, bound))], self._do(node.orelse, bound), True, [c])

    # --- containers

    def _list(self, node, bound) -> Val:
        parts = [self._do(e, bound) for e in node.elts]
        if not parts:
            return Val(F.array().cast("array<double>"), T.ArrayType(DOUBLE))
        t = reduce(V.unify, (p.dtype for p in parts))
        t = STRING if V.is_null(t) else t
        return carry(parts, F.array(*[V.cast(p, t) if not V.is_null(p.dtype) else F.lit(None).cast(t) for p in parts]), T.ArrayType(t))

    _tuple = _list

    def _dict(self, node: ast.Dict, bound) -> Val:
        if any(k is None for k in node.keys):
            raise FormulaSyntaxError("** isn't supported")
        keys, vals = [self._do(k, bound) for k in node.keys], [self._do(v, bound) for v in node.values]
        kt, vt = (reduce(V.unify, (x.dtype for x in xs)) if xs else STRING for xs in (keys, vals))
        flat = [c for k, v in zip(keys, vals, strict=True) for c in (V.cast(k, kt), V.cast(v, vt))]
        return carry([*keys, *vals], F.create_map(*flat) if flat else F.create_map().cast(T.MapType(kt, vt)), T.MapType(kt, vt))

    def _attribute(self, node: ast.Attribute, bound) -> Val:
        base = self._do(node.value, bound)
        if V.is_array(base.dtype):
            raise TypeMismatchError(f"a list has no field {node.attr!r}; use a position or a comprehension")
        got = field(base, node.attr)
        if V.is_null(got.dtype):
            raise UnknownVariableError(f"no field {node.attr!r}")
        return carry([base, got], got.col, got.dtype, base.col.isNotNull())

    def _subscript(self, node: ast.Subscript, bound) -> Val:
        if isinstance(node.value, ast.Name) and isinstance(CONSTANTS.get(node.value.id), dict):
            return V.lit(CONSTANTS[node.value.id][ast.literal_eval(node.slice)])
        base = self._do(node.value, bound)
        if isinstance(node.slice, ast.Slice):
            return self._slice(base, node.slice, bound)
        key = self._do(node.slice, bound)
        if V.is_array(base.dtype):
            k = number(key)
            i = k.col.cast("int")
            size = F.size(base.col)
            at = F.when(i >= 0, i).otherwise(size + i)
            got = item(base, F.get(base.col, at))
            return carry([base, k, got], got.col, got.dtype, (at >= 0) & (at < size))
        if V.is_str(base.dtype):
            k = number(key)
            i = k.col.cast("int")
            return carry([base, k], F.substring(base.col, F.when(i >= 0, i + 1).otherwise(i), F.lit(1)), STRING, F.when(i >= 0, i < F.length(base.col)).otherwise(-i <= F.length(base.col)))
        got = field(base, key)
        there = base.col.isNotNull()
        if isinstance(base.dtype, T.MapType):
            there = there & F.map_contains_key(base.col, key.col.cast(base.dtype.keyType))
        elif V.is_null(got.dtype):
            raise UnknownVariableError(f"no field {key.const!r}")
        return carry([base, key, got], got.col, got.dtype, there)

    def _slice(self, base: Val, node: ast.Slice, bound) -> Val:
        if node.step is not None:
            raise FormulaSyntaxError("slices have no step")
        size = F.length(base.col) if V.is_str(base.dtype) else F.size(base.col)
        ends = [number(self._do(e, bound)) if e is not None else None for e in (node.lower, node.upper)]
        place = lambda n, default: default if n is None else F.greatest(F.least(F.when(n.col < 0, size + n.col).otherwise(n.col).cast("int"), size), F.lit(0))
        low, high = place(ends[0], F.lit(0)), place(ends[1], size)
        n = F.greatest(high - low, F.lit(0))
        col = F.substring(base.col, low + 1, n) if V.is_str(base.dtype) else F.slice(base.col, low + 1, n)
        return carry([base, *(e for e in ends if e is not None)], col, base.dtype)

    def _generator(self, node, bound) -> Val:
        loop = node.generators[0]
        data = elements(self._do(loop.iter, bound))
        inner = lambda r: bound | self._bind(loop.target, r)
        kept = data
        if loop.ifs:
            kept = Val(F.filter(data.col, lambda x: reduce(lambda p, q: p & q, [V.truthy(self._do(c, inner(item(data, x)))) for c in loop.ifs])), data.dtype, data.ok, data.zero)
        oks: list[Column] = []

        def body(r: Val) -> Val:
            got = self._do(node.elt, inner(r))
            oks.append(got.ok)
            return got

        out = mapped(kept, body)
        if oks and oks[0] is not None:
            defined = F.forall(kept.col, lambda x: F.coalesce(self._do(node.elt, inner(item(kept, x))).ok, F.lit(False)))
            return carry([out], out.col, out.dtype, defined)
        return out

    _generatorexp = _generator
    _listcomp = _generator

    def _bind(self, target: ast.expr, row: Val) -> dict[str, Val]:
        if isinstance(target, ast.Name):
            return {target.id: row}
        if isinstance(target, (ast.Tuple, ast.List)):
            return {name: v for k, e in enumerate(target.elts) for name, v in self._bind(e, field(row, k)).items()}
        raise FormulaSyntaxError("a loop binds names")

    # --- calls

    def _call(self, node: ast.Call, bound) -> Val:
        if isinstance(node.func, ast.Attribute):
            return self._method(node, bound)
        name = node.func.id
        f = self.functions.get(name) or self.functions.get(next((k for k in self.functions if k.lower() == name.lower()), ""))
        if f is None:
            if name in CONSTANTS and not node.args:
                return V.lit(CONSTANTS[name])
            raise UnknownFunctionError(f"unknown function {name!r}{did_you_mean(name, self.functions)}")
        return f([self._do(a, bound) for a in node.args], {k.arg: self._do(k.value, bound) for k in node.keywords})

    def _method(self, node: ast.Call, bound) -> Val:
        base, method = self._do(node.func.value, bound), node.func.attr
        args = [self._do(a, bound) for a in node.args]
        if method == "get":
            if not args:
                raise ArgumentError("get takes a key")
            got = field(base, args[0])
            default = args[1] if len(args) > 1 else V.lit(None)
            return chosen([(got.col.isNotNull(), got)], default, True, [base])
        if method == "to_dict":
            return base
        if isinstance(base.dtype, T.MapType):
            made = {"keys": (F.map_keys(base.col), base.dtype.keyType), "values": (F.map_values(base.col), base.dtype.valueType)}
            if method in made:
                return carry([base], made[method][0], T.ArrayType(made[method][1]))
            pair = T.StructType([T.StructField("key", base.dtype.keyType), T.StructField("value", base.dtype.valueType)])
            return carry([base], F.map_entries(base.col), T.ArrayType(pair))
        if isinstance(base.dtype, T.StructType) and method == "keys":
            return Val(F.array(*[F.lit(f.name) for f in base.dtype.fields]), T.ArrayType(STRING), base.ok)
        raise TypeMismatchError(f"{base.dtype.simpleString()} has no method {method!r}")
