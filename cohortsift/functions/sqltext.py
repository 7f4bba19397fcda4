"""Raw SQL text of filters and expressions, as Spark reads it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# A string literal, or a double-quoted identifier.
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"((?:[^\"]|\"\")*)\"")


def spark_text(text: str) -> str:
    """Same text with ``"x"`` as an identifier and backslashes taken as they are."""

    def translate(found: re.Match[str]) -> str:
        name = found.group(1)
        if name is None:
            return found.group().replace("\\", "\\\\")
        return quoted(name.replace('""', '"'))

    return _QUOTED.sub(translate, text)


def quoted(name: str) -> str:
    """A name as one identifier, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def qualified(table: str | None, name: str) -> Column:
    """The column ``name`` of the table known as ``table``."""
    return F.col(f"{quoted(table)}.{quoted(name)}" if table else quoted(name))


def expression(text: str) -> Column:
    """The column a text stands for; ``a / 0`` and ``a % 0`` are NULL, other errors stay errors."""
    return F.expr(null_division(spark_text(text)))


# The words after which an operand begins anew, so that they end the one before.
_PARTING = set(
    "and or not in is like ilike rlike regexp between as when then else from for over order by partition "
    "rows range distinct escape using similar to where asc desc nulls".split()
)
_PIECE = re.compile(
    r"(?P<space>\s+)|(?P<text>'(?:[^'\\]|\\.|'')*'|`(?:[^`]|``)*`)|(?P<comment>--|/\*)"
    r"|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?\w*|\.\d+(?:[eE][+-]?\d+)?\w*)|(?P<word>\w+)"
    r"|(?P<open>[(\[])|(?P<close>[)\]])|(?P<times>[*/%])|(?P<join>::|\.)|(?P<sign><=>|->|\|\||<>|<=|>=|!=|==|<<|>>|[-+=<>!~,&|^:])"
)


@dataclass(frozen=True)
class _Piece:
    kind: str
    text: str


def null_division(text: str) -> str:
    """The same SQL with ``x / y`` as ``try_divide(x, y)`` and ``x % y`` as ``try_mod(x, y)``.

    Literals and quoted names are left as they are. Text that holds a division
    beside signs this reader does not know is refused.
    """
    pieces, at = [], 0
    while at < len(text):
        found = _PIECE.match(text, at)
        if found is None or found.lastgroup == "comment":
            if "/" in text or "%" in text:
                raise ValueError(f"cannot read {text[at : at + 20]!r} in an expression that divides: {text!r}")
            return text
        pieces.append(_Piece(found.lastgroup or "", found.group()))
        at = found.end()
    if not any(p.kind == "times" and p.text != "*" for p in pieces):
        return text
    written, rest = _written(pieces, 0, None)
    if rest != len(pieces):
        raise ValueError(f"brackets do not match in {text!r}")
    return written


def _written(pieces: list[_Piece], at: int, closing: str | None) -> tuple[str, int]:
    """The pieces up to ``closing`` (a bracket, or ``end`` of a case) as text, and where it goes on."""
    out: list[str] = []
    product = ""  # what * / % have made so far
    operator = ""  # the one that waits for its right side
    operand = ""
    space = ""

    def finish() -> None:
        nonlocal product, operator, operand
        if operator and not operand.strip():
            if operator == "*" and not product.strip():  # the star of count(*) or t.*
                out.append(product + operator + operand)
                product = operator = operand = ""
                return
            raise ValueError(f"{operator!r} has no right side")
        if operator == "*":
            product = f"{product.rstrip()} * {operand.strip()}"
        elif operator:
            name = "try_divide" if operator == "/" else "try_mod"
            lead = product[: len(product) - len(product.lstrip())]
            product = f"{lead}{name}({product.strip()}, {operand.strip()})"
        else:
            product += operand
        operator = operand = ""

    while at < len(pieces):
        piece = pieces[at]
        word = piece.text.lower()
        if piece.kind == "close" or (closing == "end" and piece.kind == "word" and word == "end"):
            if (closing or "") != word:
                raise ValueError("brackets do not match")
            break
        at += 1
        if piece.kind == "open" or (piece.kind == "word" and word == "case"):
            end = {"(": ")", "[": "]"}.get(piece.text, "end")
            inner, at = _written(pieces, at, end)
            if at >= len(pieces):
                raise ValueError("brackets do not match")
            operand += space + piece.text + inner + pieces[at].text
            at += 1
        elif piece.kind == "space":
            space = piece.text
            continue
        elif piece.kind == "times":
            if piece.text == "*" and (not (product + operand).strip() or operand.rstrip().endswith(".")):
                operand += space + piece.text
            else:
                finish()
                operator = piece.text
                if not product.strip():
                    raise ValueError(f"{operator!r} has no left side")
        elif piece.kind == "sign" and not (piece.text in "-+~" and not operand.strip()):
            finish()
            out += [product, space, piece.text]
            product = ""
        elif piece.kind == "word" and word == "div":
            raise ValueError("write a division as / instead of DIV")
        elif piece.kind == "word" and word in _PARTING and not operand.rstrip().endswith("."):
            finish()
            out += [product, space, piece.text]
            product = ""
        else:
            operand += space + piece.text
        space = ""
    finish()
    out += [product, space]
    return "".join(out), at
