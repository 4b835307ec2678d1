"""Decoded lines as source text.

A line is reverse Polish: values go on a stack as text, and a statement takes
its own off. Statements with a form (``statements.FORMS``, or text and arguments
of the opcode table) are filled in; the others have a rule here. A line can't be
split, and a file's names are needed by all its lines, so a file is one value of
an Arrow batch; nothing shuffles.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import slices
from ..sources.opcodes import DEFAULT, Op, Table, table
from . import decode as streams
from .statements import NUMBERED, EVENTS, EVENTS_OF_ONE, FORMS, KEY_MODES, NONE, OPEN_ACCESS, OPEN_LOCKS, OPEN_MODES, PUT_ACTIONS, SHAPES, TYPE_SUFFIX, TYPES, TYPES_LATER, WHOLE_ARRAY
from .structure import FLAGS_AT, TABS, layout_shift, read_names, read_sections

# Keywords of declarations, what moves in a table, default types by code, the type of a letter that none covers.
HEADS = {"DIM": "DIM", "REDIM": "REDIM", "SHARED": "SHARED", "SHARED_TYPED": "SHARED", "STATIC": "STATIC", "COMMON": "COMMON"}
ISAM = {"ISAM_MOVE": {0: "MOVEFIRST", 4: "MOVELAST", 8: "MOVENEXT", 12: "MOVEPREVIOUS"}, "ISAM_SEEK": {0: "SEEKEQ", 4: "SEEKGE", 8: "SEEKGT"}}
DEFTYPES = {1: "DEFINT", 2: "DEFLNG", 3: "DEFSNG", 4: "DEFDBL", 5: "DEFSTR"}
DEFTYPES_LATER = {1: "DEFINT", 2: "DEFLNG", 3: "DEFSNG", 4: "DEFDBL", 5: "DEFCUR", 6: "DEFSTR"}
DEFAULT_TYPE = 3
#: Words that say nothing by themselves.
SILENT = {"DOTTED_NAME", "ELSE_MARK", "STOP_MARK", "MARK_7B", "MARK_7C", "MARK_24", "MARK_8B", "MARK_8C", "MARK_8D", "MARK_8E", "TO_RANGE", "CHDRIVE_PDS", "INPUT_VARS", "CIRCLE_START", "CIRCLE_END", "CIRCLE_ASPECT"}
CALLS = ("CALL", "CALL_IMPLICIT", "CALLS")
LEAD_WORD, RAW_TEXT = {"TEXT_LINE", "REM", "DATA"}, {"REM_META", "META_INCLUDE", "PUSH_STR"}


# numbers


def spell(value: float) -> str:
    """The fewest digits that read back as the same number: no zero before the point, an exponent only where it must be."""
    if not np.isfinite(value):
        raise ValueError("not a number")
    mantissa, power = np.format_float_scientific(value, unique=True, trim="-").split("e")
    sign, digits, exponent = "-" * mantissa.startswith("-"), mantissa.strip("-").replace(".", ""), int(power)
    if not -5 < exponent < max(16, len(digits)):
        return f"{mantissa}E{'-' if exponent < 0 else '+'}{abs(exponent)}"
    if exponent < 0:
        return f"{sign}.{'0' * (-exponent - 1)}{digits}"
    whole, part = digits[: exponent + 1].ljust(exponent + 1, "0"), digits[exponent + 1 :]
    return f"{sign}{whole}{'.' * bool(part)}{part}"


def format_single(words) -> str:
    text = spell(np.frombuffer(struct.pack("<2H", *words), "<f4")[0])
    return text if "." in text or "E" in text else text + "!"


def format_double(words) -> str:
    text = spell(np.frombuffer(struct.pack("<4H", *words), "<f8")[0])
    return text.replace("E", "D") if "E" in text else text + "#"


def long_text(words, base: str) -> str:
    value = words[0] | words[1] << 16
    text = {"d": "", "X": "&H", "o": "&O"}[base] + format(value, base)
    return text + "&" * (value <= (32767 if base == "d" else 65535))


# payloads


def instr_text(mnemonic: str, payload: bytes | None) -> str | None:
    """Source text that an instruction carries, or None: a payload with a zero inside isn't text."""
    if payload is None or mnemonic not in LEAD_WORD | RAW_TEXT:
        return None
    body = payload
    if mnemonic in LEAD_WORD:
        body = payload[2:].rstrip(b"\0")
        if b"\0" in body:
            return None
    text = streams.expand_runs(body).decode("latin-1")
    return text[:-1] if mnemonic == "REM" and text.endswith(" ") else text


def comment_column(mnemonic: str, payload: bytes | None) -> int | None:
    return int.from_bytes(payload[:2], "little") if mnemonic in LEAD_WORD and payload and len(payload) > 1 else None


@dataclass
class Signature:
    """ref, kind bits, whether brackets were written, the ALIAS, and (ref, mode, type) of each parameter."""

    ref: int
    kind: int
    listed: bool
    alias: str = ""
    params: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def is_function(self) -> bool:
        return self.kind >> 8 & 3 == 2

    @property
    def suffix(self) -> str:
        return TYPE_SUFFIX.get(self.kind & 127, "") if self.kind & 128 else ""


def parse_signature(payload: bytes, later: bool = False) -> Signature | None:
    """Three words, a parameter's words for each (a fourth in the later product), then the ALIAS, whose length the kind holds."""
    width = 4 if later else 3
    words = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2])
    if len(words) < 3:
        return None
    ref, kind, count = words[:3]
    listed = count != NONE
    given = words[3 : 3 + width * count] if listed else ()
    if len(given) < width * count * listed:
        return None
    at, size = 6 + 2 * len(given), kind >> 10 & 31
    alias = payload[at : at + size].decode("latin-1") if len(payload) >= at + size else ""
    return Signature(ref, kind, listed, alias, [tuple(given[i : i + 3]) for i in range(0, len(given), width)])


# lines


@dataclass
class Context:
    """What a line is read with: its file's names, and its section."""

    names: dict[int, tuple[int, bytes]]
    later: bool = False
    tabs: bool = False
    in_module: bool = True
    is_function: bool = False
    static: bool = False

    def name(self, ref: int) -> str:
        flags, payload = self.names.get(ref, (NUMBERED, b""))
        return f"<{ref:#06x}>" if flags in (2, NUMBERED) else payload.decode("latin-1")

    def label(self, ref: int) -> str:
        flags, payload = self.names.get(ref, (0, b""))
        if flags in (2, NUMBERED):
            return str(int.from_bytes(payload[:2], "little"))
        return payload.decode("latin-1") if flags & 4 else f"<{ref:#06x}>"

    def type_name(self, code: int) -> str:
        return "ANY" if code == 0 else (TYPES_LATER if self.later else TYPES).get(code) or self.name(code)

    def indent(self, width: int) -> str:
        return "\t" * (width // 8) + " " * (width % 8) if self.tabs else " " * width


def signature_text(sig: Signature, mnemonic: str, ctx: Context) -> str:
    params = ", ".join(parameter_text(*p, ctx) for p in sig.params)
    name = ctx.name(sig.ref) + sig.suffix
    if mnemonic != "DECLARE":
        return f"{mnemonic} {name}" + f" ({params})" * bool(params)
    more = " CDECL" * bool(sig.kind & 0x8000) + f' ALIAS "{sig.alias}"' * bool(sig.alias)
    return f"DECLARE {'FUNCTION' if sig.is_function else 'SUB'} {name}{more}" + f" ({params})" * sig.listed


def parameter_text(ref: int, mode: int, kind: int, ctx: Context) -> str:
    text = ctx.name(ref) + (TYPE_SUFFIX.get(kind, "") if mode & 512 else "") + "()" * bool(mode & 1024)
    text += f" AS {ctx.type_name(kind)}" * bool(mode & 8192)
    return "BYVAL " * bool(mode & 4096) + "SEG " * (bool(mode & 2048) and not mode & 4096) + text


def merge_coords(values: list[str]) -> list[str]:
    """What a point goes to belongs to the point before it."""
    made: list[str] = []
    for v in values:
        if made and re.match(r"-(STEP)?\(", v):
            made[-1] += v
        else:
            made.append(v)
    return made


def print_join(items: list[str], keyword: str = "PRINT", channel: str | None = None, using: str | None = None) -> str:
    head = keyword + (f" {channel}," if channel else "") + (f" USING {using};" if using is not None else "")
    return " ".join([head, *items]).rstrip()


def letter_ranges(letters) -> str:
    """Letter numbers (A is 0) as ranges."""
    marks = "".join(chr(65 + i) if i in letters else " " for i in range(26))
    return ", ".join(run if len(run) == 1 else f"{run[0]}-{run[-1]}" for run in marks.split())


def deftype_letters(operands) -> tuple[int, set[int]]:
    _, tail, head = operands
    bits = head << 16 | tail & 0xFFC0
    return tail & 63, {i for i in range(26) if bits >> 31 - i & 1}


class _Line:
    """One line while it is made: values on the stack, and parts, each with what joins it to the next."""

    def __init__(self, instrs: list[dict], ctx: Context, ops: Table):
        self.instrs, self.ctx, self.ops = instrs, ctx, ops
        self.stack: list[str] = []
        self.parts: list[list[str]] = []
        self.glue, self.prefix = ": ", ""
        self.marks: list[bool] = []
        self.heads: list[str] | None = None
        self.block = ""
        self.finished, self.upper_only = 0, set()
        self.type_: tuple[str, int] | None = None
        self.as_column: int | None = None
        self.printing: list[str] = []
        self.keyword, self.channel, self.using = "PRINT", None, None
        self.prompt, self.prompt_flags = "", 0
        self.field: str | None = None
        self.comment_at: int | None = None
        self.colon_before_comment = self.ends_in_colon = False
        self.reading: int | None = None
        self.declares = any(i["mnemonic"] in HEADS for i in instrs)
        self.at = 0

    def pop(self, n: int) -> list[str]:
        if len(self.stack) < n:
            raise ValueError("too few values on the stack")
        cut = len(self.stack) - n
        found = self.stack[cut:]
        del self.stack[cut:]
        return found

    def all(self) -> list[str]:
        return self.pop(len(self.stack))

    def emit(self, text: str, glue: str | None = None) -> None:
        self.parts.append([self.prefix + text, self.glue if glue is None else glue])
        self.prefix = ""

    def before_colon(self) -> str:
        """A keyword without its arguments keeps a blank if a colon comes later."""
        return " " * any(i["mnemonic"] == "COLON" for i in self.instrs[self.at + 1 :])

    def given(self) -> list[str]:
        """Arguments by their marks, places left out among them; empty ones at the end go."""
        values = iter(self.pop(min(sum(self.marks), len(self.stack))))
        found = [next(values, "") if m else "" for m in self.marks]
        self.marks = []
        while found and not found[-1]:
            found.pop()
        return found

    def run(self) -> None:
        for self.at, i in enumerate(self.instrs):
            mnemonic = i["mnemonic"]
            if mnemonic is None:
                raise ValueError(f"unknown opcode {i['code']:#06x}")
            if mnemonic in SILENT:
                continue
            op = self.ops.of(i["code"], self.ctx.later) or Op(i["code"], mnemonic, (), None, "", "stmt")
            rule = _RULES.get(mnemonic) or _BY_FORM.get(op.form) or _plain
            rule(self, op, i)

    def subscripts(self, count: int) -> str:
        return "" if count == WHOLE_ARRAY else f"({', '.join(self.pop(count))})"

    def bounds(self, words: int) -> list[str]:
        """Two words stand for each dimension, whether one bound was written or two; names finished before are no bounds."""
        dims: list[str] = []
        for _ in range(words // 2):
            top = len(self.stack) - 1
            if top < self.finished:
                break
            if top in self.upper_only or top == self.finished:
                dims += self.pop(1)
            else:
                low, high = self.pop(2)
                dims.append(f"{low} TO {high}")
        return dims[::-1]

    def declare(self, text: str) -> None:
        if self.type_:
            text += f" AS {self.type_[0]}"
            self.as_column = self.as_column if self.as_column is not None else self.type_[1]
            self.type_ = None
        self.stack.append(text)
        self.finished = len(self.stack)

    def finish(self, indent: int) -> None:
        if self.field is not None and self.stack:
            self.emit(f"FIELD {self.field}, {', '.join(self.all())}")
        if self.printing or self.using is not None:
            self.emit(print_join(self.printing, self.keyword, self.channel, self.using))
        if self.heads is not None and self.stack:
            note = self.parts.pop() if self.comment_at is not None and self.parts and self.parts[-1][0].startswith("'") else None
            names = self.all()
            if self.type_:
                names[-1] += f" AS {self.type_[0]}"
                self.as_column = self.as_column if self.as_column is not None else self.type_[1]
            text = " ".join([*self.heads, *([self.block] if self.block else []), ", ".join(names)])
            if len(names) == 1 and self.as_column and " AS " in text:
                head, _, rest = text.partition(" AS ")
                text = head.ljust(max(self.as_column - indent, len(head) + 1)) + f"AS {rest}"
            self.emit(text)
            if note:
                self.parts.append(note)
        if self.stack:
            raise ValueError(f"{len(self.stack)} values left on the stack")


_RULES: dict[str, Callable[[_Line, Op, dict], None]] = {}


def on(*mnemonics: str):
    def put(rule):
        _RULES.update(dict.fromkeys(mnemonics, rule))
        return rule

    return put


def _variable(line: _Line, op: Op, i: dict) -> None:
    kind = next(k for k in ("ARRDECL", "ARRSET", "ARRAY", "STORE", "DECL", "LOAD") if op.mnemonic.startswith(k))
    name = line.ctx.name(i["operands"][-1]) + op.mnemonic[len(kind) :]
    if kind == "DECL":
        line.declare(name)
    elif kind == "ARRDECL" or kind == "ARRAY" and (line.declares or line.type_):
        line.declare(f"{name}({', '.join(line.bounds(i['operands'][0]))})")
    elif kind == "STORE":
        line.emit(f"{name} = {line.pop(1)[0]}")
    elif kind == "ARRSET":
        target = name + line.subscripts(i["operands"][0])
        line.emit(f"{target} = {line.pop(1)[0]}")
    else:
        line.stack.append(name + (line.subscripts(i["operands"][0]) if kind == "ARRAY" else ""))


def _literal(line: _Line, op: Op, i: dict) -> None:
    words = i["operands"]
    if op.mnemonic == "PUSH_STR":
        text = f'"{instr_text("PUSH_STR", i["payload"])}"'
    elif op.mnemonic in ("PUSH_SINGLE", "PUSH_DOUBLE"):
        text = (format_single if op.mnemonic == "PUSH_SINGLE" else format_double)(words)
    elif op.mnemonic in ("PUSH_HEX", "PUSH_OCT"):
        text = f"&H{words[0]:X}" if op.mnemonic == "PUSH_HEX" else f"&O{words[0]:o}"
    elif len(words) == 2:
        text = long_text(words, {"PUSH_LONG": "d", "PUSH_HEX_LONG": "X", "PUSH_OCT_LONG": "o"}[op.mnemonic])
    else:
        text = str(words[0]) if words else op.text
    line.stack.append(text)


def _function(line: _Line, op: Op, i: dict) -> None:
    text = f"{op.text}({', '.join(line.pop(op.arity))})" if op.arity else op.text
    after = line.instrs[line.at + 1]["mnemonic"] if line.at + 1 < len(line.instrs) else None
    if op.mnemonic in ("SPC", "TAB") and after not in ("PRINT_FUNC_SEMI", "PRINT_FUNC_COMMA"):
        line.printing.append(text + ";")
    else:
        line.stack.append(text)


def _infix(line: _Line, op: Op, i: dict) -> None:
    left, right = line.pop(2)
    line.stack.append(f"{left} {op.text} {right}")


def _prefix(line: _Line, op: Op, i: dict) -> None:
    line.stack.append(op.text + " " * op.text.isalpha() + line.pop(1)[0])


_BY_FORM = {"var": _variable, "literal": _literal, "func": _function, "infix": _infix, "prefix": _prefix}


def _plain(line: _Line, op: Op, i: dict) -> None:
    """A form filled in, marked arguments, as many arguments as the table says, or all there are."""
    form = FORMS.get(op.mnemonic)
    if form:
        places = re.findall(r"\{(\d)", form)
        values = line.pop(1 + max(map(int, places))) if places else []
        fill = {"l": lambda: line.ctx.label(i["operands"][op.operands.index("ref")]), "n": lambda: line.ctx.name(i["operands"][op.operands.index("ref")])}
        line.emit(re.sub(r"\{(\w)[^}]*\}", lambda m: fill[m[1]]() if m[1] in fill else values[int(m[1])], form), " " if form.startswith("IF ") else None)
        return
    if not op.text:
        raise ValueError(f"{op.mnemonic} can't be written")
    if line.marks:
        given = line.given()
    elif op.arity is not None:
        given = line.pop(op.arity)
    else:
        given = merge_coords(line.all())
    line.emit(f"{op.text} {', '.join(given)}" if given else op.text + line.before_colon() * (op.arity is None or op.mnemonic == "COLOR"))


@on("PAREN")
def _paren(line, op, i):
    line.stack.append(f"({line.pop(1)[0]})")


@on("FIELD")
def _field(line, op, i):
    line.stack.append(f"{line.pop(1)[0]}.{line.ctx.name(i['operands'][0])}")


@on("FIELD_SET")
def _field_set(line, op, i):
    value, base = line.pop(2)
    line.emit(f"{base}.{line.ctx.name(i['operands'][0])} = {value}")


@on("ARG", "ARG_OMITTED")
def _mark(line, op, i):
    line.marks.append(op.mnemonic == "ARG")


@on("COLON")
def _colon(line, op, i):
    rest = {x["mnemonic"] for x in line.instrs[line.at + 1 :]} - {"DOTTED_NAME"}
    line.reading = None
    line.ends_in_colon |= not rest
    line.colon_before_comment |= rest == {"REM"}


@on("CONST")
def _const(line, op, i):
    line.prefix, line.glue = "CONST ", ", "


@on("LET")
def _let(line, op, i):
    line.prefix = "LET "


# declarations


@on(*HEADS)
def _head(line, op, i):
    line.heads = line.heads or []
    if HEADS[op.mnemonic] not in line.heads:  # stored the other way round; REDIM comes once a name
        line.heads.insert(0, HEADS[op.mnemonic])
    if op.mnemonic == "COMMON" and i["operands"][1] != NONE:
        line.block = f"/{line.ctx.name(i['operands'][1])}/"


@on("DIM_ARRAY")
def _upper_only(line, op, i):
    line.upper_only.add(len(line.stack))


@on("AS_TYPE", "AS_USER_TYPE", "FIXED_STRING")
def _as(line, op, i):
    first, *rest = i["operands"]
    if op.mnemonic == "FIXED_STRING":
        line.type_ = f"STRING * {rest[0]}", rest[1]
    else:
        line.type_ = line.ctx.name(first) if op.mnemonic == "AS_USER_TYPE" else (TYPES_LATER if line.ctx.later else TYPES).get(first, "ANY"), rest[0]


@on("TYPE_MEMBER")
def _member(line, op, i):
    line.heads = []
    line.stack.append(line.ctx.name(i["operands"][0]))


@on("DEFTYPE")
def _deftype(line, op, i):
    code, letters = deftype_letters(i["operands"])
    line.emit(f"{(DEFTYPES_LATER if line.ctx.later else DEFTYPES).get(code, 'DEFINT')} {letter_ranges(letters)}")


@on("DECLARE", "SUB", "FUNCTION")
def _header(line, op, i):
    sig = parse_signature(i["payload"] or b"", line.ctx.later)
    text = op.text if sig is None else signature_text(sig, op.mnemonic, line.ctx)
    line.emit(text + " STATIC" * (line.ctx.static and op.mnemonic != "DECLARE"))


@on("DEF_FN")
def _def_fn(line, op, i):
    sig = parse_signature((i["payload"] or b"")[2:], line.ctx.later)
    if sig is None:
        raise ValueError("a function without a signature")
    params = ", ".join(parameter_text(*p, line.ctx) for p in sig.params)
    line.emit(f"DEF {line.ctx.name(sig.ref)}{sig.suffix}" + f" ({params})" * bool(params))


@on("DEF_FN_END_LINE")
def _def_fn_value(line, op, i):
    line.parts[-1][0] += f" = {line.pop(1)[0]}"


# text


@on("REM")
def _comment(line, op, i):
    line.comment_at = comment_column("REM", i["payload"])
    line.emit("'" + (instr_text("REM", i["payload"]) or ""))


@on("REM_META", "DATA", "TEXT_LINE")
def _stored(line, op, i):
    line.emit({"REM_META": "REM", "DATA": "DATA", "TEXT_LINE": ""}[op.mnemonic] + (instr_text(op.mnemonic, i["payload"]) or ""))


@on("META_DYNAMIC", "META_STATIC", "META_INCLUDE")
def _meta(line, op, i):
    if not line.parts:
        return
    before, text = line.instrs[line.at - 1]["payload"] or b"", line.parts[-1][0]
    if op.mnemonic == "META_INCLUDE":
        text += f"$INCLUDE: '{instr_text(op.mnemonic, i['payload'])}"
    else:
        text += " " * (before.endswith(b" ") and not text.endswith(" ")) + op.text
    line.parts[-1][0] = text


# control


@on("IF_THEN_LINE", "IF_THEN_ALT", "IF_THEN_BLOCK")
def _if(line, op, i):
    line.emit(f"IF {line.pop(1)[0]} THEN", None if op.mnemonic == "IF_THEN_BLOCK" else " ")


@on("IF_THEN_GOTO")
def _if_goto(line, op, i):
    line.emit(f"IF {line.pop(1)[0]} THEN {line.ctx.label(i['operands'][0])}", " ")


@on("ELSEIF")
def _elseif(line, op, i):
    more = {x["mnemonic"] for x in line.instrs[line.at + 1 :]} - {"DOTTED_NAME", "REM"}
    line.emit(f"ELSEIF {line.pop(1)[0]} THEN", " " if more else None)


@on("ELSE", "ELSE_AFTER_LINE", "ELSE_LINE")
def _else(line, op, i):
    if line.parts:
        line.parts[-1][1] = " "
    line.emit(line.ctx.label(i["operands"][0]) if op.mnemonic == "ELSE_LINE" else "ELSE", " " if line.parts or op.mnemonic != "ELSE" else None)


@on("NEXT")
def _next(line, op, i):
    line.emit(" ".join(["NEXT", *(line.pop(1) if line.stack else [])]))


@on("CASE")
def _case(line, op, i):
    value = line.pop(1)[0]
    if line.parts and line.parts[-1][0].startswith("CASE"):
        line.parts[-1][0] += f", {value}"
    else:
        line.emit(f"CASE {value}")


@on("CASE_RANGE")
def _case_range(line, op, i):
    line.emit("CASE {} TO {}".format(*line.pop(2)))


@on("ON_ERROR")
def _on_error(line, op, i):
    line.emit("ON ERROR GOTO " + ("0" if i["operands"][0] == NONE else line.ctx.label(i["operands"][0])))


@on("ON_GOTO", "ON_GOSUB")
def _on_jump(line, op, i):
    body = (i["payload"] or b"")[: len(i["payload"] or b"") // 2 * 2]
    targets = ", ".join(line.ctx.label(ref) for ref in struct.unpack(f"<{len(body) // 2}H", body))
    line.emit(f"ON {line.pop(1)[0]} {op.mnemonic[3:]} {targets}")


@on("GOTO_ALT", "GOSUB_ALT")
def _jump(line, op, i):
    line.emit(f"{op.text} {line.ctx.label(i['operands'][0])}")


@on("CALL", "CALLS", "CALL_IMPLICIT")
def _call(line, op, i):
    given, name = ", ".join(line.pop(i["operands"][0])), line.ctx.name(i["operands"][1])
    line.emit(f"{name} {given}".rstrip() if op.mnemonic == "CALL_IMPLICIT" else f"{op.mnemonic} {name}" + f"({given})" * bool(given))


@on("END_SUB", "EXIT_SUB")
def _end_sub(line, op, i):
    word = "DEF" if line.ctx.in_module and op.mnemonic == "EXIT_SUB" else "FUNCTION" if line.ctx.is_function else "SUB"
    line.emit(f"{op.mnemonic[:-4]} {word}")


@on("STOP")
def _stop(line, op, i):
    line.emit("STOP")


# events, coordinates and drawing


@on("TIMER_EVENT", "PEN_EVENT", "UEVENT", "PLAY_EVENT")
def _event(line, op, i):
    line.stack.append(op.text)


_EVENT_WORDS = {EVENTS_OF_ONE.get(m, m): word for word, m in EVENTS.items() if m not in ("PEN_EVENT", "UEVENT")}


@on(*_EVENT_WORDS)
def _event_of(line, op, i):
    line.stack.append(f"{_EVENT_WORDS[op.mnemonic]}({line.pop(1)[0]})")


@on("EVENT_ON", "EVENT_OFF", "EVENT_STOP")
def _event_state(line, op, i):
    line.emit(f"{line.pop(1)[0]} {op.text}")


@on("ON_EVENT_GOSUB")
def _on_event(line, op, i):
    line.emit(f"ON {line.pop(1)[0]} GOSUB {line.ctx.label(i['operands'][0])}")


@on("KEY_MODE")
def _key_mode(line, op, i):
    line.emit(f"KEY {KEY_MODES.get(i['operands'][0], i['operands'][0])}")


@on("COORD", "COORD_TO", "COORD_STEP", "COORD_TO_STEP")
def _point(line, op, i):
    x, y = line.pop(2)
    line.stack.append(f"{'-' * ('_TO' in op.mnemonic)}{'STEP' * ('STEP' in op.mnemonic)}({x}, {y})")


@on("LINE", "LINE_NOCOLOR")
def _draw_line(line, op, i):
    given, shape = merge_coords(line.all()), SHAPES.get(i["operands"][0])
    line.emit(f"LINE {', '.join(given)}" + ((", , " if op.mnemonic == "LINE_NOCOLOR" else ", ") + shape if shape else ""))


@on("LINE_STYLE", "LINE_STYLE_NOCOLOR")
def _draw_styled(line, op, i):
    *given, style = merge_coords(line.all())
    where, colour = [*given, "", ""][:2]
    line.emit(f"LINE {where}, {colour if op.mnemonic == 'LINE_STYLE' else ''}, {SHAPES.get(i['operands'][0], '')}, {style}")


@on("CIRCLE", "CIRCLE_COLOR")
def _draw_circle(line, op, i):
    """Centre, radius, colour, start, end, aspect: the marks say which of the last three were written."""
    marks = [x["mnemonic"] for x in line.instrs[: line.at] if x["mnemonic"].startswith("CIRCLE_")]
    given = merge_coords(line.all())
    later = dict(zip(marks, given[len(given) - len(marks) :], strict=False))
    base = given[: len(given) - len(marks)]
    slots = [*base, *[""] * (3 - len(base)), *(later.get(m, "") for m in ("CIRCLE_START", "CIRCLE_END", "CIRCLE_ASPECT"))]
    while slots and not slots[-1]:
        slots.pop()
    line.emit(f"CIRCLE {', '.join(slots)}")


@on("PUT_GRAPHICS")
def _put(line, op, i):
    action = PUT_ACTIONS.get(i["operands"][0])
    line.emit(f"PUT {', '.join([*merge_coords(line.all()), *([action] if action else [])])}")


@on("PAINT", "PAINT_ALT", "WIDTH")
def _paint(line, op, i):
    line.marks = []
    line.emit(f"{op.text} {', '.join(merge_coords(line.all()))}")


@on("VIEW", "VIEW_SCREEN")
def _view(line, op, i):
    a, b, c, d, *rest = line.all()
    if len(line.marks) == 1 and len(rest) == 1:  # one place left out and one written: the colour is what's missing
        rest = ["", *rest]
    line.marks = []
    line.emit(f"{op.text} {', '.join([f'({a}, {b})-({c}, {d})', *rest])}")


# files


@on("FILE_NUMBER")
def _file_number(line, op, i):
    line.stack.append("#" + line.pop(1)[0])


@on("FIELD_STMT")
def _field_of(line, op, i):
    line.field = line.pop(1)[0]


@on("FIELD_ITEM")
def _field_item(line, op, i):
    line.stack.append("{} AS {}".format(*line.pop(2)))


@on("OPEN", "OPEN_RANDOM")
def _open(line, op, i):
    name, channel, *length = line.all()
    word = i["operands"][0]
    mode = OPEN_MODES.get(word & 255, "RANDOM" if op.mnemonic == "OPEN_RANDOM" else "")
    access, lock = OPEN_ACCESS.get(word >> 8 & 3), OPEN_LOCKS.get(word >> 8 & 112)
    clauses = [f"FOR {mode}"] * bool(mode) + [f"ACCESS {access}"] * bool(access) + [lock] * bool(lock)
    line.emit(" ".join(["OPEN", name, *clauses, "AS", channel, *(f"LEN = {n}" for n in length)]))


@on("OPEN_ISAM")
def _open_isam(line, op, i):
    name, place, channel = line.pop(3)
    line.emit(f"OPEN {name} FOR ISAM {line.ctx.name(i['operands'][1])} {place} AS {channel}")


@on("OPEN_MODE_STRING", "OPEN_MODE_PLAIN")
def _open_old(line, op, i):
    line.emit(f"OPEN {', '.join(line.all())}")


@on(*ISAM)
def _isam(line, op, i):
    given = ", ".join(line.pop(op.arity or 0))
    line.emit(f"{ISAM[op.mnemonic].get(i['operands'][0], op.mnemonic)} {given}".rstrip())


@on("LOCK", "UNLOCK")
def _lock(line, op, i):
    channel, *span = line.all()
    if len(span) == 2:
        span = [f"TO {span[1]}" if False in line.marks else f"{span[0]} TO {span[1]}"]
    line.marks = []
    line.emit(f"{op.text} {', '.join([channel, *span])}")


@on("CLS")
def _cls(line, op, i):
    more = bool(line.instrs[line.at + 1 :])
    line.emit(f"CLS {line.pop(1)[0]}" if line.stack else "CLS" + " " * (bool(line.marks) and more))
    line.marks = []


@on("READ")
def _read(line, op, i):
    names = ", ".join(line.all())
    if line.reading is None:
        line.reading = len(line.parts)
        line.emit(f"READ {names}")
    else:
        line.parts[line.reading][0] += f", {names}"


@on("INPUT_CHANNEL", "PRINT_FILE")
def _channel(line, op, i):
    line.channel = line.pop(1)[0]


@on("INPUT_PROMPT")
def _prompt(line, op, i):
    line.prompt_flags = (i["payload"] or b"\0")[0]
    line.prompt = line.pop(1)[0] if line.prompt_flags & 4 else ""


def _asked(flags: int, prompt: str) -> str:
    return "; " * bool(flags & 2) + (prompt + (", " if flags & 1 else "; ")) * bool(flags & 4)


@on("INPUT", "INPUT_VARS_END")
def _input(line, op, i):
    names, whole = line.all(), op.mnemonic == "INPUT_VARS_END"
    flags = i["operands"][0] if whole else line.prompt_flags
    if line.channel:
        lead = f"{line.channel}, "
    else:
        lead = _asked(flags, names.pop(0) if whole and flags & 4 else line.prompt)
    line.emit(("LINE " * whole) + f"INPUT {lead}{', '.join(names)}")
    line.channel, line.prompt, line.prompt_flags = None, "", 0


# PRINT


@on("LPRINT", "WRITE_FILE")
def _print_as(line, op, i):
    line.keyword = "LPRINT" if op.mnemonic == "LPRINT" else "WRITE"


@on("PRINT_USING")
def _using(line, op, i):
    line.using = line.pop(1)[0]


@on("PRINT_SEMI", "PRINT_COMMA")
def _print_value(line, op, i):
    sign = ";" if op.mnemonic == "PRINT_SEMI" else ","
    line.printing.append((line.pop(1)[0] if line.stack else "") + sign)


@on("PRINT_FUNC_SEMI", "PRINT_FUNC_COMMA")
def _print_spaced(line, op, i):
    had = bool(line.stack)
    if had:
        line.printing.append(line.pop(1)[0] + ";")
    if op.mnemonic == "PRINT_FUNC_COMMA":
        line.printing.append(",")
    elif not had and not line.printing:
        line.printing.append(";")


@on("PRINT_ITEM", "PRINT_NEWLINE")
def _print(line, op, i):
    if op.mnemonic == "PRINT_ITEM":
        line.printing += line.pop(1)
    bare = not line.printing
    line.emit(print_join(line.printing, line.keyword, line.channel, line.using) + line.before_colon() * bare)
    line.printing, line.keyword, line.channel, line.using = [], "PRINT", None, None


def render_line(node: dict, ctx: Context, ops: Table) -> str:
    """A decoded line as text. ValueError where it can't be written."""
    line = _Line(node["instrs"], ctx, ops)
    line.run()
    line.finish(node["indent"])
    labelled, lead = node["label_ref"] is not None, ""
    if labelled:
        flags, payload = ctx.names.get(node["label_ref"], (NUMBERED, b""))
        mark = ctx.label(node["label_ref"])
        lead = mark + ":" * (flags not in (2, NUMBERED) and not mark.isdigit()) + " " * max(node["indent"], 1)
    text = ""
    for k, (part, _) in enumerate(line.parts):
        if line.comment_at is not None and k == len(line.parts) - 1 and part.startswith("'"):
            text = comment_aligned(text, line.comment_at, len(lead) if labelled else node["indent"], part, line.colon_before_comment)
        else:
            text += (line.parts[k - 1][1] if k else "") + part
    text += ":" * line.ends_in_colon
    if labelled:
        return lead + text if text else lead.rstrip()
    return ctx.indent(node["indent"]) + text


def comment_aligned(text: str, column: int, base: int, comment: str, colon: bool = False) -> str:
    """text, then comment at its column, counted from base (the indent, or the label's width); a colon keeps one blank after it."""
    text += ":" * colon
    return text.ljust(max(column - base, len(text) + colon)) + comment


def safe_line(node: dict, ctx: Context, ops: Table) -> tuple[str, str | None]:
    """Text and error: what can't be written is a comment that says so."""
    try:
        return render_line(node, ctx, ops), None
    except (ValueError, IndexError, KeyError, TypeError) as e:
        return f"{ctx.indent(node['indent'])}' <not rendered: {e}>", str(e) or type(e).__name__


# files


def shown(section: dict, lines: list[dict]) -> list[dict]:
    """Lines that are written: not the default types that a procedure begins with, and none that were included."""
    hidden = section["section"] > 0 and lines and lines[0]["instrs"] and lines[0]["instrs"][0]["mnemonic"] == "DEFTYPE"
    return [x for x in lines[1 if hidden else 0 :] if not x["included"]]


def deftype_state(lines: list[dict]) -> list[int] | None:
    """The type of each letter by the first record of default types, or None without one."""
    found = next((i["operands"] for x in lines for i in x["instrs"] if i["mnemonic"] == "DEFTYPE"), None)
    if found is None:
        return None
    code, letters = deftype_letters(found)
    return [code if i in letters else DEFAULT_TYPE for i in range(26)]


def deftype_delta(before: list[int], after: list[int], later: bool = False) -> list[str]:
    """Lines that lead from one state to the other, by type."""
    changed = [i for i in range(26) if before[i] != after[i]]
    names = DEFTYPES_LATER if later else DEFTYPES
    return [f"{names.get(code, 'DEFSNG')} {letter_ranges({i for i in changed if after[i] == code})}" for code in sorted({after[i] for i in changed})]


@dataclass
class Program:
    """A file: names by reference, sections with their decoded lines."""

    names: dict[int, tuple[int, bytes]]
    sections: list[dict]
    later: bool
    tabs: bool

    @classmethod
    def read(cls, content: bytes, ops: Table) -> Program:
        later = layout_shift(content) == 1
        names = {n["ref"]: (n["flags"], n["payload"]) for n in read_names(content)}
        found, _ = read_sections(content)
        for s in found:
            s["lines"], s["truncated"] = streams.decode(s["body"], ops, later)
        return cls(names, found, later, bool(content[FLAGS_AT] & TABS))

    def called(self, i: dict) -> str | None:
        """The name that a call names."""
        if i["mnemonic"] not in CALLS or not i["operands"] or i["operands"][-1] not in self.names:
            return None
        return self.names[i["operands"][-1]][1].decode("latin-1")

    def context(self, section: dict) -> Context:
        function = any(i["mnemonic"] == "FUNCTION" for x in section["lines"] for i in x["instrs"])
        return Context(self.names, self.later, self.tabs, section["section"] == 0, function, bool((section["kind_byte"] or 0) & 0x80))

    def rendered(self, section: dict, ops: Table) -> Iterator[tuple[dict, str, str | None]]:
        ctx = self.context(section)
        for node in shown(section, section["lines"]):
            yield node, *safe_line(node, ctx, ops)

    def text(self, ops: Table, by_name: bool = True) -> list[tuple[str, str | None]]:
        """Lines of the whole file: the module, then the procedures by name, with changes of default types and blank lines between."""
        module, *rest = self.sections or [None]
        if module is None:
            return []
        out: list[tuple[str, str | None]] = []
        state = deftype_state(module["lines"])
        for section in [module, *(sorted(rest, key=lambda s: s["name"].lower()) if by_name else rest)]:
            if section is not module and state is not None:
                wanted = deftype_state(section["lines"]) or [DEFAULT_TYPE] * 26
                out += [(x, None) for x in deftype_delta(state, wanted, self.later)]
                state = wanted
            out += [(text, error) for _, text, error in self.rendered(section, ops)]
            if section is module and rest and any(i["mnemonic"] == "REM_META" for x in section["lines"] for i in x["instrs"]):
                while out and not out[-1][0].strip():
                    out.pop()
                out += [("", None), ("REM $STATIC", None)]
            elif out and out[-1][0].strip():
                out.append(("", None))
        return out


CALLED = "array<struct<instr_no:int,mnemonic:string,name:string>>"
LINES = f"lines array<struct<section:int,section_name:string,line_no:int,shown_no:int,text:string,error:string,instrs:{CALLED}>>, error string"
TEXT = "lines array<struct<line_no:int,line:string,error:string>>, error string"
def line_rows(program: Program, ops: Table) -> list[tuple]:
    rows = []
    for s in program.sections:
        for k, (node, text, error) in enumerate(program.rendered(s, ops)):
            said = [(i["instr_no"], i["mnemonic"], program.called(i)) for i in node["instrs"]]
            rows.append((s["section"], s["name"], node["line_no"], k + 1, text, error, said))
    return rows


def _of_files(read: Callable[[Program, Table], list], schema: str, ops: Table):
    """Arrow UDF over whole files: rows, or an error."""

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            made = []
            for content in batch:
                try:
                    made.append((read(Program.read(content or b"", ops), ops), None))
                except ValueError as e:
                    made.append((None, str(e)))
            yield pd.DataFrame(made, columns=["lines", "error"])

    return run


def render_lines(files: DataFrame, opcodes: str = DEFAULT) -> DataFrame:
    """files: path, content. A row per written line: section, section_name, line_no, shown_no (from 1), text, error and instrs.

    instrs holds the mnemonics, and the names that calls name. A file that can't be read is one row with an error.
    """
    rows = files.select("path", _of_files(line_rows, LINES, table(opcodes))("content").alias("r")).select("path", F.col("r.error").alias("bad"), F.explode_outer("r.lines").alias("l"))
    return rows.select("path", "l.section", "l.section_name", "l.line_no", "l.shown_no", "l.text", F.coalesce("l.error", "bad").alias("error"), "l.instrs")


def render_files(files: DataFrame, opcodes: str = DEFAULT, by_name: bool = True) -> DataFrame:
    """files: path, content. path, line_no, line and error of whole files as text."""
    read = _of_files(lambda p, ops: [(k, *x) for k, x in enumerate(p.text(ops, by_name))], TEXT, table(opcodes))
    rows = files.select("path", read("content").alias("r")).select("path", F.col("r.error").alias("bad"), F.explode_outer("r.lines").alias("l"))
    return rows.select("path", "l.line_no", "l.line", F.coalesce("l.error", "bad").alias("error"))


SIGNATURE = "ref int, kind int, listed boolean, is_function boolean, suffix string, alias string, params array<struct<ref:int,mode:int,type:int>>"


def signature_rows(instrs: DataFrame, later: bool = False) -> DataFrame:
    """instrs: as of decode.instr_rows. The procedure headers among them, with the fields of their signatures; null fields where the payload is short."""

    @F.pandas_udf(SIGNATURE)
    def read(payloads: pd.Series) -> pd.DataFrame:
        made = []
        for body in payloads:
            sig = parse_signature(body or b"", later)
            made.append((None,) * 7 if sig is None else (sig.ref, sig.kind, sig.listed, sig.is_function, sig.suffix, sig.alias, [{"ref": r, "mode": m, "type": t} for r, m, t in sig.params]))
        return pd.DataFrame(made, columns=["ref", "kind", "listed", "is_function", "suffix", "alias", "params"])

    rows = instrs.where(F.col("mnemonic").isin("DECLARE", "SUB", "FUNCTION"))
    return rows.select("path", "section", "line_no", "instr_no", "mnemonic", read("payload").alias("s")).select("path", "section", "line_no", "instr_no", "mnemonic", "s.*")


def text_rows(instrs: DataFrame) -> DataFrame:
    """instrs: as of decode.instr_rows. Those that carry source text, with it and the column of a comment."""

    @F.pandas_udf("text string, at int")
    def read(mnemonics: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        pairs = list(zip(mnemonics, payloads, strict=True))
        return pd.DataFrame({"text": [instr_text(m, p) for m, p in pairs], "at": pd.Series([comment_column(m, p) for m, p in pairs], dtype="Int32")})

    rows = instrs.where(F.col("mnemonic").isin(*LEAD_WORD, *RAW_TEXT))
    return rows.select("path", "section", "line_no", "instr_no", "mnemonic", read("mnemonic", "payload").alias("t")).select("path", "section", "line_no", "instr_no", "mnemonic", "t.text", F.col("t.at").alias("comment_column"))
