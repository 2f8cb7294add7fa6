"""Formulas of saved presets, as typed columns. Their text is read as forms of the catalogue; none of it is run."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.functions import formulas as X
from reportloom.operators.columns import value_of

#: A formula's text as nested tuples: the form's name, then its parts.
Form = tuple

# Signs that part the items of a list of formulas outside of quotes and brackets, plain and full width, quotes
# that word processors write, and the parts of a time format.
_PIECE = re.compile(r"""'[^'\n]*'|"[^"\n]*"|[(\[]|[)\]]|[,;\n，；]|[^'"()\[\],;\n，；]+|.""", re.S)
_QUOTES = str.maketrans("‘’“”", "''\"\"")
_ITEM = re.compile(r"""\s*(?:df\[\s*(?:'([^']+)'|"([^"]+)")\s*\]|df\.(\w+)|([^\[\]'"=()]+?))\s*(?:=(?!=)\s*(.+))?""", re.S)
_TIME_PARTS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy"}

_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.BitAnd: "&", ast.BitOr: "|"}
_COMPARED = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
#: Text methods and how many texts they take.
_TEXT_METHODS = {"upper": 0, "lower": 0, "strip": 0, "len": 0, "contains": 1, "replace": 2}
_DATE_PARTS = {"year": X.year, "month": X.month, "day": X.day, "dayofweek": X.weekday}


def split_formulas(text: str) -> list[str]:
    """Items of a preset's list of formulas: cut at commas, semicolons and line ends outside of quotes and brackets."""
    items, item, depth = [], "", 0
    for piece in _PIECE.findall((text or "").translate(_QUOTES)):
        depth += (piece in "([") - (piece in ")]") if len(piece) == 1 else 0
        if depth <= 0 and piece in ",;\n，；":
            items.append(item)
            item = ""
        else:
            item += " " if piece == "\n" else piece
    return [found for i in [*items, item] if (found := i.strip())]


def preset_fields(text: str) -> list:
    """A preset's formulas as items of ``calc_fields``: a name alone for an empty column, else ``[name, {"preset": formula}]``.

    Every formula is read, so one in no known form is an error here, named by its text.
    """
    fields: list = []
    for item in split_formulas(text):
        found = _ITEM.fullmatch(item)
        if not found:
            raise ValueError(f"not 'name = formula': {item!r}")
        listed, name, formula = found[1] or found[2] or found[3], found[4], found[5]
        if formula is not None:
            formula_form(formula)
            fields.append([listed or name, {"preset": formula}])
        else:
            fields.append([listed, {"preset": "''"}] if listed else name)
    return fields


def formula_form(text: str) -> Form:
    """The form of a formula's text; text in no form of the catalogue is an error."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as error:
        raise ValueError(f"not a formula: {text!r} ({error})") from None
    return _form(tree)


def _refused(node: ast.AST) -> ValueError:
    return ValueError(f"a formula that no preset writes: {ast.unparse(node)!r}")


def _constant(node: ast.AST | None, kind: type):
    """The value of a literal, possibly with a minus."""
    match node:
        case None:
            return None
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=value)) if kind is int and type(value) is int:
            return -value
        case ast.Constant(value=value) if type(value) is kind:
            return value
    raise _refused(node)


def _form(node: ast.AST) -> Form:
    match node:
        case ast.Constant(value=bool() | int() | float() | str() | None):
            return ("value", node.value)
        case ast.Subscript(value=ast.Name(id="df"), slice=ast.Constant(value=str(name))):
            return ("column", name)
        case ast.Subscript(value=ast.Attribute(value=inner, attr="str"), slice=ast.Slice(lower=lower, upper=upper, step=None)):
            return ("slice", _form(inner), _constant(lower, int) or 0, _constant(upper, int))
        case ast.Subscript(value=ast.Attribute(value=inner, attr="str"), slice=place):
            return ("letter", _form(inner), _constant(place, int))
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return ("negative", _form(inner))
        case ast.UnaryOp(op=ast.Invert(), operand=inner):
            return ("not", _form(inner))
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            return ("binary", _BINARY[type(op)], _form(left), _form(right))
        case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARED:
            return ("compare", _COMPARED[type(op)], _form(left), _form(right))
        case ast.Attribute(value=ast.Attribute(value=inner, attr="dt"), attr=part) if part in _DATE_PARTS or part == "days":
            return ("part", part, _form(inner))
        case ast.Call():
            return _call(node)
    raise _refused(node)


def _call(node: ast.Call) -> Form:
    options = {k.arg: k.value for k in node.keywords}
    match node.func, node.args:
        case ast.Attribute(value=ast.Name(id="np"), attr="where"), [condition, yes, no] if not options:
            return ("where", _form(condition), _form(yes), _form(no))
        case ast.Attribute(value=ast.Name(id="np"), attr="ceil" | "floor" as name), [inner] if not options:
            return (name, _form(inner))
        case ast.Attribute(value=ast.Name(id="pd"), attr="to_datetime"), [inner] if not options:
            return ("time", _form(inner))
        case ast.Attribute(value=ast.Attribute(value=ast.Name(id="pd"), attr="Timestamp"), attr="now"), [] if not options:
            return ("now",)
        case ast.Name(id="round"), [inner, *digits] if len(digits) < 2 and not options:
            return ("round", _form(inner), _constant(digits[0], int) if digits else 0)
        case ast.Attribute(value=ast.Attribute(value=inner, attr="dt"), attr="strftime"), [text] if not options:
            return ("written", _form(inner), _constant(text, str))
        case ast.Attribute(value=ast.Attribute(value=inner, attr="str"), attr=name), texts if _TEXT_METHODS.get(name) == len(texts):
            if set(options) - ({"na"} if name == "contains" else set()):
                raise _refused(node)
            return ("text", name, _form(inner), [_constant(t, str) for t in texts], _constant(options.get("na"), bool))
        case ast.Attribute(value=inner, attr="astype"), [ast.Name(id=kind) | ast.Constant(value=kind)] if kind in ("int", "float", "str") and not options:
            return ("astype", _form(inner), kind)
        case ast.Attribute(value=inner, attr="fillna"), [value] if not options:
            return ("fillna", _form(inner), _form(value))
        case ast.Attribute(value=inner, attr="isna" | "isnull"), [] if not options:
            return ("missing", _form(inner))
        case ast.Attribute(value=inner, attr="notna" | "notnull"), [] if not options:
            return ("not", ("missing", _form(inner)))
        case ast.Attribute(value=inner, attr="round"), [*digits] if len(digits) < 2 and not options:
            return ("round", _form(inner), _constant(digits[0], int) if digits else 0)
    raise _refused(node)


_NUMBERS = ("whole", "number")


class _Typed:
    """Turns forms into columns of one table, each with its kind: whole, number, text, flag, time, span or nothing."""

    def __init__(self, df: DataFrame, as_of: Column):
        self.df, self.as_of = df, as_of

    def of(self, form: Form) -> tuple[Column, str]:
        name, *parts = form
        return getattr(self, f"_{name}")(*parts)

    def _wanted(self, form: Form, *kinds: str) -> Column:
        column, kind = self.of(form)
        if kind not in kinds and kind != "nothing":
            raise TypeError(f"{_said(form)} is {kind}, not {' or '.join(kinds)}; convert it with astype")
        return column

    def _value(self, value):
        kinds = {bool: "flag", int: "whole", float: "number", str: "text", type(None): "nothing"}
        kind = kinds[type(value)]
        if kind == "whole" and not -(2**63) <= value < 2**63:
            return F.lit(float(value)), "number"
        return F.lit(value).cast("bigint") if kind == "whole" else F.lit(value), kind

    def _column(self, name):
        if name not in self.df.columns:
            raise ValueError(f"unknown column {name!r}; available: {', '.join(self.df.columns)}")
        dtype, column = self.df.schema[name].dataType, value_of(self.df, name)
        if isinstance(dtype, T.IntegralType):
            return column.cast("bigint"), "whole"
        if isinstance(dtype, (T.FractionalType, T.DecimalType)):
            return column.cast("double"), "number"
        kinds = {T.StringType: "text", T.BooleanType: "flag", T.DateType: "time", T.TimestampType: "time", T.TimestampNTZType: "time", T.NullType: "nothing"}
        if type(dtype) not in kinds:
            raise TypeError(f"column {name!r} is {dtype.simpleString()}")
        return column, kinds[type(dtype)]

    def _negative(self, inner):
        column, kind = self.of(inner)
        return F.negative(self._wanted(inner, *_NUMBERS)) if kind == "number" else F.try_subtract(F.lit(0).cast("bigint"), column), kind

    def _binary(self, sign, left, right):
        (a, one), (b, other) = self.of(left), self.of(right)
        if sign in "&|":
            a, b = (F.coalesce(self._wanted(side, "flag"), F.lit(False)) for side in (left, right))
            return (a & b if sign == "&" else a | b), "flag"
        if sign == "+" and "text" in (one, other):
            return F.concat(self._wanted(left, "text"), self._wanted(right, "text")), "text"
        if sign == "-" and "time" in (one, other):
            # Kept as whole days, the only part of it that formulas read.
            return X.days_apart(self._wanted(left, "time"), self._wanted(right, "time")), "span"
        a, b = (self._wanted(side, *_NUMBERS) for side in (left, right))
        if sign == "/":
            return F.try_divide(a.cast("double"), b.cast("double")), "number"
        kind = "whole" if one == other == "whole" else "number"
        if kind == "number":
            a, b = a.cast("double"), b.cast("double")
        made: dict[str, Callable] = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": X.remainder}
        return made[sign](a, b), kind

    def _compare(self, sign, left, right):
        (a, one), (b, other) = self.of(left), self.of(right)
        if {one, other} <= set(_NUMBERS) | {"nothing"}:
            a, b = (a, b) if one == other else (a.cast("double"), b.cast("double"))
        elif "time" in (one, other):
            a, b = X.to_date(a), X.to_date(b)
        elif one != other:
            if sign not in ("==", "!="):
                raise TypeError(f"{_said(left)} ({one}) cannot be ordered against {_said(right)} ({other})")
            a, b = a.cast("string"), b.cast("string")
        # A missing value is equal to nothing and in no order; so it differs from everything.
        tests = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
        return F.coalesce(tests[sign], F.lit(sign == "!=")), "flag"

    def _not(self, inner):
        return ~self._wanted(inner, "flag"), "flag"

    def _joined(self, first, second):
        """Two values that meet in one column, in a kind that holds both."""
        (a, one), (b, other) = first, second
        if one == other or "nothing" in (one, other):
            kind = other if one == "nothing" else one
            return a, b, kind
        if {one, other} == set(_NUMBERS):
            return a.cast("double"), b.cast("double"), "number"
        return a.cast("string"), b.cast("string"), "text"

    def _where(self, condition, yes, no):
        a, b, kind = self._joined(self.of(yes), self.of(no))
        return X.choose(self._wanted(condition, "flag"), a, b), kind

    def _fillna(self, inner, value):
        a, b, kind = self._joined(self.of(inner), self.of(value))
        return F.coalesce(a, b), kind

    def _missing(self, inner):
        return self.of(inner)[0].isNull(), "flag"

    def _astype(self, inner, kind):
        column, own = self.of(inner)
        if own in ("time", "span") and kind != "str":
            raise TypeError(f"{_said(inner)} is {own}, not a number")
        made = {"int": (X.to_int, "whole"), "float": (X.to_float, "number"), "str": (X.to_text, "text")}
        convert, kind = made[kind]
        return convert(column), kind

    def _slice(self, inner, lower, upper):
        column = self._wanted(inner, "text")
        length = F.char_length(column)
        begin = F.lit(lower) if lower >= 0 else F.greatest(length + lower, F.lit(0))
        end = length if upper is None else F.lit(upper) if upper >= 0 else length + upper
        return F.substring(column, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), "text"

    def _letter(self, inner, place):
        column = self._wanted(inner, "text")
        there = F.char_length(column) > place if place >= 0 else F.char_length(column) >= -place
        return F.when(there, F.substring(column, place + 1 if place >= 0 else place, 1)), "text"

    def _text(self, name, inner, texts, missing):
        column = self._wanted(inner, "text")
        if name == "contains":
            found = X.has_text(column, *texts)
            return (found if missing is None else F.coalesce(found, F.lit(missing))), "flag"
        made = {"upper": X.upper, "lower": X.lower, "strip": X.strip, "len": X.text_length, "replace": X.replace_text}
        return (made[name](column, *texts).cast("bigint"), "whole") if name == "len" else (made[name](column, *texts), "text")

    def _time(self, inner):
        return X.to_date(self._wanted(inner, "text", "time")), "time"

    def _now(self):
        return self.as_of, "time"

    def _part(self, part, inner):
        if part == "days":
            return self._wanted(inner, "span"), "whole"
        return _DATE_PARTS[part](self._wanted(inner, "time")).cast("bigint"), "whole"

    def _written(self, inner, text):
        parts = re.findall(r"%(.)|([^%]+)", text)
        unknown = [sign for sign, _ in parts if sign and sign not in _TIME_PARTS]
        if unknown:
            raise ValueError(f"unknown part %{unknown[0]} in the time format {text!r}")
        quoted = "".join(_TIME_PARTS[sign] if sign else "'" + plain.replace("'", "''") + "'" for sign, plain in parts)
        return F.date_format(X.to_date(self._wanted(inner, "time")), quoted), "text"

    def _round(self, inner, digits):
        column, kind = self.of(inner)
        column = self._wanted(inner, *_NUMBERS)
        if kind == "number" and digits == 0:
            # The same without a decimal for every row; the sum makes a negative zero a zero.
            return F.rint(column) + F.lit(0.0), kind
        return X.round_half_even(column, digits), kind

    def _ceil(self, inner):
        return F.ceil(self._wanted(inner, *_NUMBERS)), "whole"

    def _floor(self, inner):
        return F.floor(self._wanted(inner, *_NUMBERS)), "whole"


def _said(form: Form) -> str:
    return repr(form[1]) if form[0] in ("value", "column") else f"the {form[0]}"


def preset_column(df: DataFrame, text: str, as_of: Column | None = None) -> Column:
    """A preset's formula as a column of the table, typed by the table's own columns.

    Known are the forms of the formula catalogue, in any combination: columns ``df['name']``, numbers, texts, arithmetic,
    comparisons, ``&``, ``|``, ``~``, ``astype``, ``fillna``, ``isna``, ``round``, the ``str`` and ``dt`` forms, ``np.where``, ``np.ceil``,
    ``np.floor``, ``pd.to_datetime`` and ``pd.Timestamp.now`` (``as_of``, by default the current time). Anything else is a
    ``ValueError`` that names it. Kinds that do not go together, such as text plus a number, are a ``TypeError``.

    Text that is no number and division by zero give null; null stays null, also as text; comparisons with null do not hold,
    but ``!=`` does; a condition that is null takes the second branch.
    """
    now = F.current_timestamp() if as_of is None else as_of
    column, kind = _Typed(df, now).of(formula_form(text))
    if kind == "span":
        raise TypeError(f"{text!r} is a span of time; take its days with .dt.days")
    return column.cast("string") if kind == "nothing" else column
