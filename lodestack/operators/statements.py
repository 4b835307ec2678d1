"""Statements of a line as instructions, and how statements are written.

``FORMS`` says how the statements that need it are written; the other plain ones
follow from the opcode table (text, then the arguments). The parser tries the
forms of a keyword, the longest first, and the renderer fills the same forms in.
What no form can say (declarations, lists with places left out, PRINT and INPUT,
drawing, OPEN, procedure headers) has a rule of its own here and in ``render``.

A place in a form is ``{n}``, an expression that is the n-th value pushed, or
with a letter: v a variable, t what can be assigned to, # a file number, a a
whole array, c a point. ``{l}`` is a label, ``{n}`` a name among the operands.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import NamedTuple

from ..sources.opcodes import Table
from .lexer import END, NUMBER, STRING, WORD, Token, lex, number_type

# Fixed values of the language: how statements are written, by mnemonic.
FORMS = {
    "BLOAD_ONE": "BLOAD {0}", "BLOAD": "BLOAD {0}, {1}", "BSAVE": "BSAVE {0}, {1}, {2}",
    "DATE$_SET": "DATE$ = {0}", "DEF_SEG": "DEF SEG", "DEF_SEG_TO": "DEF SEG = {0}",
    "ELSEIF": "ELSEIF {0} THEN",
    "FOR_STEP": "FOR {0v} = {1} TO {2} STEP {3}", "FOR": "FOR {0v} = {1} TO {2}",
    "GET_FILE_BARE": "GET {0#}", "GET_FILE": "GET {0#}, {1}", "GET_FILE_NOREC": "GET {0#}, , {1}", "GET_FILE_VAR": "GET {0#}, {1}, {2}",
    "GOSUB": "GOSUB {l}", "GOTO": "GOTO {l}",
    "IF_GOTO": "IF {0} GOTO {l}",
    "LSET": "LSET {1t} = {0}", "RSET": "RSET {1t} = {0}",
    "MID_ASSIGN3": "MID$({3}, {0}, {1}) = {2}", "MID_ASSIGN2": "MID$({2}, {0}) = {1}",
    "NAME": "NAME {0} AS {1}",
    "ON_ERROR": "ON ERROR GOTO {l}",
    "PALETTE_USING": "PALETTE USING {0a}",
    "PRESET_NOCOLOR": "PRESET {0c}", "PRESET": "PRESET {0c}, {1}", "PSET_NOCOLOR": "PSET {0c}", "PSET": "PSET {0c}, {1}",
    "PUT_FILE_NOREC": "PUT {0#}, , {1}", "PUT_FILE_VAR": "PUT {0#}, {1}, {2}",
    "RESTORE_LABEL": "RESTORE {l}", "RESUME_LABEL": "RESUME {l}", "RETURN_LABEL": "RETURN {l}", "RUN_LINE": "RUN {l}",
    "SELECT_CASE": "SELECT CASE {0}",
    "TIME$_SET": "TIME$ = {0}", "TYPE": "TYPE {n}",
    "VIEW_PRINT": "VIEW PRINT {0} TO {1}",
    "WIDTH_FILE": "WIDTH {0#}, {1}", "WIDTH_LPRINT": "WIDTH LPRINT {0}",
    "WINDOW": "WINDOW ({0}, {1})-({2}, {3})", "WINDOW_SCREEN": "WINDOW SCREEN ({0}, {1})-({2}, {3})",
}
# Statements with a list of expressions, those of them that mark each place, and what a jump slot holds before a run.
LISTS = {
    "CHAIN": "CHAIN", "CLEAR": "CLEAR", "CLOSE": "CLOSE", "CLS": "CLS", "COLOR": "COLOR", "FILES": "FILES", "IOCTL": "IOCTL", "KEY": "KEY",
    "LOCATE": "LOCATE", "LOCK": "LOCK", "PALETTE": "PALETTE", "PUT_FILE": "PUT", "SCREEN": "SCREEN", "SEEK_STMT": "SEEK", "UNLOCK": "UNLOCK",
}
MARKED = ("CLEAR", "COLOR", "LOCATE", "SCREEN")
FRESH = {"IF_THEN_LINE": 0, "IF_THEN_BLOCK": 0, "ELSE": 0}
# Numbers that stand for words.
TYPES = {1: "INTEGER", 2: "LONG", 3: "SINGLE", 4: "DOUBLE", 5: "STRING"}
TYPES_LATER = {1: "INTEGER", 2: "LONG", 3: "SINGLE", 4: "DOUBLE", 5: "CURRENCY", 6: "STRING"}
TYPE_SUFFIX = {1: "%", 2: "&", 3: "!", 4: "#", 5: "$"}
CASE_IS = {"=": "CASE_IS_EQ", "<": "CASE_IS_LT", ">": "CASE_IS_GT", "<=": "CASE_IS_LE", "=<": "CASE_IS_LE", ">=": "CASE_IS_GE", "=>": "CASE_IS_GE", "<>": "CASE_IS_NE", "><": "CASE_IS_NE"}
OPEN_MODES = {1: "INPUT", 2: "OUTPUT", 4: "RANDOM", 8: "APPEND", 32: "BINARY"}
OPEN_ACCESS = {1: "READ", 2: "WRITE", 3: "READ WRITE"}
OPEN_LOCKS = {16: "LOCK READ WRITE", 32: "LOCK WRITE", 48: "LOCK READ", 64: "SHARED"}
PUT_ACTIONS = {0: "OR", 1: "AND", 2: "PRESET", 3: "PSET", 4: "XOR"}
KEY_MODES = {0: "OFF", 1: "ON", 2: "LIST"}
SHAPES = {0: "", 1: "B", 2: "BF"}
EVENTS = {"COM": "COM_EVENT", "KEY": "KEY_EVENT", "PEN": "PEN_EVENT", "PLAY": "PLAY_EVENT", "SIGNAL": "SIGNAL_EVENT", "STRIG": "STRIG_EVENT", "TIMER": "TIMER_EVENT", "UEVENT": "UEVENT"}
EVENTS_OF_ONE = {"PLAY_EVENT": "PLAY_EVENT_N", "TIMER_EVENT": "TIMER_SELECT"}
ENDS = {"DEF": "END_DEF", "FUNCTION": "END_SUB", "IF": "END_IF", "SELECT": "CASE_END", "SUB": "END_SUB", "TYPE": "END_TYPE"}
# Fixed values of the language: binary operators, loosest first.
BINDING = [{"IMP": "IMP"}, {"EQV": "EQV"}, {"XOR": "XOR"}, {"OR": "OR"}, {"AND": "AND"}, {"=": "EQ", "<>": "NE", "><": "NE", "<": "LT", ">": "GT", "<=": "LE", "=<": "LE", ">=": "GE", "=>": "GE"}, {"+": "ADD", "-": "SUBTRACT"}, {"MOD": "MOD"}, {"\\": "IDIVIDE"}, {"*": "MULTIPLY", "/": "DIVIDE"}]
_POWER = {sign: (level, mnemonic) for level, row in enumerate(BINDING) for sign, mnemonic in row.items()}
_CONVERSIONS = ("CINT", "CLNG", "CSNG", "CDBL")
WHOLE_ARRAY = 0x8000
NONE = 0xFFFF
#: Words after which a statement follows without a colon.
_OPEN_ENDED = ("IF_THEN_LINE", "IF_GOTO", "IF_THEN_GOTO", "ELSE", "ELSE_AFTER_LINE", "ELSEIF", "ELSE_LINE", "COLON")


class Ref(NamedTuple):
    """A name that the file's table holds: flags say what it is."""

    text: str
    flags: int = 0


class Item(NamedTuple):
    """An instruction: operands are numbers and names; a payload is bytes, or numbers and names that are words of it."""

    mnemonic: str
    operands: tuple = ()
    payload: object = None
    pad: bytes = b"\0"


LABEL, NUMBERED, PROCEDURE = 4, 6, 64


def label(text: str) -> Ref:
    return Ref(text, NUMBERED if text.isdigit() and int(text) <= 0xFFFF else LABEL)


def place_parts(form: str) -> list[str]:
    """A form's words, signs and places."""
    return re.findall(r"\{[^}]*\}|[A-Za-z]+\$?|\S", form)


@lru_cache(maxsize=4)
def forms_of(ops: Table) -> dict[str, list[tuple[str, list[str]]]]:
    """Forms by first word, the longest first: those listed, and those that follow from the opcode table."""
    found = dict(FORMS)
    for op in sorted(ops.plain.values(), key=lambda op: op.code):
        plain = op.form == "stmt" and op.text and op.arity is not None and not {"ref", "str", "argc"} & set(op.operands)
        if plain and op.mnemonic not in found and op.mnemonic not in LISTS and op.text[0].isalpha() and op.mnemonic not in _OWN_RULE:
            found[op.mnemonic] = " ".join([op.text, ", ".join(f"{{{i}}}" for i in range(op.arity))]).strip()
    found |= {"RESTORE": "RESTORE", "CLS_BARE": "CLS"}
    by_word = defaultdict(list)
    for mnemonic, form in found.items():
        parts = place_parts(form)
        by_word[parts[0]].append((mnemonic, parts))
    for rows in by_word.values():
        rows.sort(key=lambda row: -len(row[1]))
    return dict(by_word)


#: Statements that a form of one keyword and its arguments doesn't describe.
_OWN_RULE = {
    "AS_TYPE", "BYVAL_ARG", "CALL", "CASE", "CASE_ELSE", "CASE_RANGE", "CIRCLE", "COM_EVENT", "COMMON", "CONST", "DEFTYPE", "DIM", "DIM_ARRAY", "EVENT_OFF", "EVENT_ON", "EVENT_STOP", "EXIT_SUB", "FIXED_STRING",
    "IF_THEN_ALT", "IF_THEN_BLOCK", "IF_THEN_LINE", "KEY_EVENT", "KEY_MODE", "LET", "META_DYNAMIC", "META_STATIC", "ON_EVENT_GOSUB", "PEN_EVENT", "PLAY", "PLAY_EVENT", "PLAY_EVENT_N", "PRINT_COMMA", "PRINT_ITEM",
    "PRINT_NEWLINE", "PRINT_SEMI", "PRINT_USING", "READ", "REDIM", "SEG_ARG", "SHARED", "SHARED_TYPED", "SIGNAL_EVENT", "STATIC", "STRIG_EVENT", "TIMER_EVENT", "TIMER_SELECT", "UEVENT", "ELSE", "ELSE_AFTER_LINE",
    "END_SUB", "CASE_END", "END_DEF", "END_IF", "END_TYPE", "CASE_IS_EQ", "CASE_IS_LT", "CASE_IS_GT", "CASE_IS_LE", "CASE_IS_GE", "CASE_IS_NE", "EXIT_DO", "EXIT_FOR", "NEXT_BARE", "OPTION_BASE", "OPTION_BASE_0",
    "STRIG", "RUN_FILE", "COLON", "FIELD_STMT", "COORD_STEP", "COORD_TO_STEP", "FILE_NUMBER", "SHELL_FUNC", "CHDRIVE_PDS", "CLS",
}


class Parser:
    """One line's tokens."""

    def __init__(self, tokens: list[Token], ops: Table):
        self.tokens, self.at, self.ops = tokens, 0, ops
        self.words, self.last = [t.word for t in tokens], len(tokens) - 1

    # tokens

    def word(self, ahead: int = 0) -> str:
        return self.words[min(self.at + ahead, self.last)]

    def take(self) -> Token:
        token = self.tokens[self.at]
        if token.kind == END:
            raise ValueError("the line ends too early")
        self.at += 1
        return token

    def has(self, *words: str) -> bool:
        """Passes over the words if they come next."""
        for ahead, word in enumerate(words):
            if self.word(ahead) != word:
                return False
        self.at += len(words)
        return True

    def need(self, word: str) -> None:
        if not self.has(word):
            raise ValueError(f"expected {word!r}, found {self.tokens[self.at].text!r}")

    def name(self) -> Token:
        token = self.take()
        if token.kind != WORD:
            raise ValueError(f"expected a name, found {token.text!r}")
        return token

    def over(self, ahead: int = 0) -> bool:
        """Whether the statement ends here."""
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)].kind == END or self.word(ahead) in (":", "'")

    def listed(self, read: Callable[[], list], sign: str = ",") -> list[list]:
        found = [read()]
        while self.has(sign):
            found.append(read())
        return found

    # expressions

    def expression(self, loosest: int = 0) -> list[Item]:
        made = self.signed()
        while (bound := _POWER.get(self.word())) and bound[0] >= loosest:
            self.at += 1
            made += [*self.expression(bound[0] + 1), Item(bound[1])]
        return made

    def signed(self) -> list[Item]:
        pending = []
        while (sign := self.word()) in ("-", "+", "NOT"):
            pending += {"-": [Item("NEGATE")], "NOT": [Item("NOT")], "+": []}[sign]
            self.at += 1
        made = self.operand()
        if self.has("^"):  # tighter than the signs before it; its right side may have its own
            made += [*self.signed(), Item("POWER")]
        return made + pending[::-1]

    def operand(self) -> list[Item]:
        if self.has("("):
            made = self.expression()
            self.need(")")
            return [*made, Item("PAREN")]
        if self.word() == "#":
            return self.file_number()
        token = self.tokens[self.at]
        if token.kind == NUMBER:
            self.at += 1
            return [Item("PUSH", (token.text,))]
        if token.kind == STRING:
            self.at += 1
            return [pushed(token.text)]
        if token.kind != WORD or token.word in _POWER:
            raise ValueError(f"expected an operand, found {token.text!r}")
        return self.named()

    def file_number(self) -> list[Item]:
        return [*self.expression(), Item("FILE_NUMBER")] if self.has("#") else self.expression()

    def arguments(self) -> list[list[Item]] | None:
        """What stands in brackets, if they follow."""
        if not self.has("("):
            return None
        if self.has(")"):
            return []
        found = self.listed(self.expression)
        self.need(")")
        return found

    def named(self) -> list[Item]:
        """A variable, an element or a call, a function, and the fields of it."""
        token = self.name()
        word, called = token.word, self.word() == "("
        if called and word in ("UBOUND", "LBOUND"):
            self.at += 1
            made = [*self.whole_array(), *(self.expression() if self.has(",") else [])]
            self.need(")")
            return [*made, Item(word if len(made) == 1 else f"{word}_DIM")]
        if called and (word in self.ops.spelled or word in _CONVERSIONS):
            given = self.arguments()
            return [*sum(given, []), Item(self.ops.by_arity.get((word, len(given)), self.ops.spelled.get(word, word)))]
        if not called and (word, 0) in self.ops.by_arity:
            return [Item(self.ops.by_arity[word, 0])]
        return self.variable(token, "LOAD", "ARRAY")

    def variable(self, token: Token, plain: str, indexed: str) -> list[Item]:
        given = self.arguments()
        if given is None:
            made = [Item(plain + token.suffix, (Ref(token.text),))]
        else:
            made = [*sum(given, []), Item(indexed + token.suffix, (len(given), Ref(token.text)))]
        while self.has("."):
            made.append(Item("FIELD", (Ref(self.name().text),)))
        return made

    def whole_array(self) -> list[Item]:
        token = self.name()
        return [Item("ARRAY" + token.suffix, (WHOLE_ARRAY, Ref(token.text)))]

    def point(self, to: bool = False) -> list[Item]:
        step = self.has("STEP")
        self.need("(")
        x = self.expression()
        self.need(",")
        y = self.expression()
        self.need(")")
        return [*x, *y, Item("COORD" + "_TO" * to + "_STEP" * step)]

    def points(self) -> list[Item]:
        """A point, and what it goes to; the first may be left out."""
        made = [] if self.word() == "-" else self.point()
        return made + self.point(to=True) if self.has("-") else made

    # statements

    def place(self, kind: str) -> list[Item]:
        if kind == "v":
            token = self.name()
            return [Item("LOAD" + token.suffix, (Ref(token.text),))]
        if kind == "t":
            return self.variable(self.name(), "LOAD", "ARRAY")
        if kind == "a":
            token = self.name()
            given = self.arguments()
            return [*sum(given or [], []), Item("ARRAY" + token.suffix, (1 if given else WHOLE_ARRAY, Ref(token.text)))]
        return {"#": self.file_number, "c": self.point, "": self.expression}[kind]()

    def form(self, mnemonic: str, parts: list[str]) -> list[Item]:
        values, operands, control = {}, {}, None
        for part in parts:
            if part == "{l}":
                operands["ref"] = label(self.target())
            elif part == "{n}":
                operands["ref"] = Ref(self.name().text)
            elif part[0] == "{":
                values[int(part[1])] = made = self.place(part[2:-1])
                if part[2:-1] == "v":
                    control = made[0].operands[0]
            else:
                self.need(part)
        if not (self.over() or self.word() == "ELSE" or mnemonic in _OPEN_ENDED):
            raise ValueError(f"unexpected {self.tokens[self.at].text!r} after a statement")
        made = sum((values[i] for i in sorted(values)), [])
        if mnemonic == "CLS_BARE":
            return [Item("ARG"), Item("CLS")]
        if control is not None:
            return [*made, Item(mnemonic, (NONE, control))]
        kinds = self.ops.named[mnemonic].operands
        return [*made, Item(mnemonic, tuple(operands.get(k, FRESH.get(mnemonic, NONE)) for k in kinds))]

    def target(self) -> str:
        """A label or a line number."""
        token = self.take()
        if token.kind not in (WORD, NUMBER):
            raise ValueError(f"expected a label, found {token.text!r}")
        return token.text

    def at_line_number(self) -> bool:
        token = self.tokens[self.at]
        return token.kind == NUMBER and number_type(token.text) in ("integer", "long") and (self.over(1) or self.word(1) == "ELSE")

    def statement(self) -> list[Item]:
        token = self.tokens[self.at]
        word = token.word
        if token.kind == WORD and self.word(1) == "=" and word not in ("DATE$", "TIME$"):
            return self.assignment_or_call()
        begin, errors = self.at, []
        rule = _RULES.get(word)
        options = [lambda m=m, parts=parts: self.form(m, parts) for m, parts in forms_of(self.ops).get(word, ()) if token.kind == WORD]
        if rule is not None:
            options.insert(0 if word in _RULES_FIRST else len(options), lambda: rule(self))
        if word in _LISTED:
            options.append(lambda: self.list_statement(_LISTED[word]))
        for option in options:
            self.at = begin
            try:
                return option()
            except ValueError as e:
                errors.append(e)
        self.at = begin
        if errors:
            raise errors[-1]
        if token.kind == WORD and self.word(1) == "AS":
            self.at += 1
            return [Item("TYPE_MEMBER", (Ref(token.text),)), *self.as_clause()]
        return self.assignment_or_call()

    def list_statement(self, mnemonic: str) -> list[Item]:
        """Expressions in a list; a place left out keeps a mark. A written one weighs two in the last word, one left out one."""
        self.at += 1
        marked, made, weight = mnemonic in MARKED, [], 0
        if self.over():
            made = [Item("ARG")] if marked else []
        else:
            for given in self.listed(lambda: [] if self.word() == "," or self.over() else self.file_number()):
                weight += 2 if given else 1
                made += [Item("ARG_OMITTED")] if not given else [Item("ARG"), *given] if marked else given
        kinds = self.ops.named[mnemonic].operands
        return [*made, Item(mnemonic, tuple(weight if marked else NONE for _ in kinds))]

    def assignment_or_call(self) -> list[Item]:
        begin = self.at
        try:
            target = self.variable(self.name(), "STORE", "ARRSET")
        except ValueError:
            target = None
        if target and self.has("="):
            *before, last = target
            before = [Item(i.mnemonic.replace("STORE", "LOAD").replace("ARRSET", "ARRAY"), i.operands) for i in before]
            if last.mnemonic == "FIELD":
                last = Item("FIELD_SET", last.operands)
            return [*self.expression(), *before, last]
        self.at = begin
        name = self.name()
        given = [] if self.over() or self.word() == "ELSE" else self.listed(self.expression)
        return [*sum(given, []), Item("CALL_IMPLICIT", (len(given), Ref(name.text, PROCEDURE)))]

    def comment(self) -> list[Item]:
        token, body = self.take(), self.take()
        command = body.text.strip()
        name = command.upper().split(":")[0]
        text, more = body.text, []
        if name in ("$DYNAMIC", "$STATIC"):
            more = [Item("META_" + name[1:], (NONE,))]
        elif name == "$INCLUDE":
            path = command.partition(":")[2].strip()
            more = [Item("META_INCLUDE", (), path.removeprefix("'").encode("latin-1", "replace"))]
        if more:
            text = text[: len(text) - len(text.lstrip())]
        raw = text.encode("latin-1", "replace")
        return [Item("REM", (), token.at.to_bytes(2, "little") + raw) if token.text == "'" else Item("REM_META", (), raw), *more]

    # declarations

    def as_clause(self) -> list[Item]:
        if self.word() != "AS":
            return []
        column = self.take().at
        named = self.name().text
        if named.upper() == "STRING" and self.has("*"):
            return [Item("FIXED_STRING", (6, int(self.take().text), column))]
        code = _TYPE_CODES.get(named.upper())
        return [Item("AS_USER_TYPE", (Ref(named), column)) if code is None else Item("AS_TYPE", (code, column))]

    def declared(self, indexed: str) -> list[Item]:
        token, made, dims = self.name(), [], None
        if self.has("("):
            dims = 0
            while not self.has(")"):
                if dims:
                    self.need(",")
                low = self.expression()
                made += [*low, *self.expression()] if self.has("TO") else [Item("DIM_ARRAY"), *low]
                dims += 1
        made += self.as_clause()
        return [*made, Item("DECL" + token.suffix, (Ref(token.text),)) if dims is None else Item(indexed + token.suffix, (2 * dims, Ref(token.text)))]

    def parameters(self) -> list[tuple] | None:
        """(name, mode, type) of each parameter, or None if there are no brackets."""
        if not self.has("("):
            return None
        found = []
        while not self.has(")"):
            if found:
                self.need(",")
            mode = 0
            while self.word() in ("BYVAL", "SEG"):
                mode |= 4096 if self.take().word == "BYVAL" else 2048
            token, kind = self.name(), 1
            if token.suffix:
                mode, kind = mode | 512, _SUFFIX_CODES[token.suffix]
            if self.has("("):
                self.need(")")
                mode |= 1024
            if self.has("AS"):
                named = self.name().text
                mode, kind = mode | 8192, _TYPE_CODES.get(named.upper(), Ref(named))
            found.append((Ref(token.text), mode, kind))
        return found

    def header(self, kind: str, mnemonic: str) -> list[Item]:
        """A procedure's name and parameters as DECLARE, SUB and FUNCTION keep them."""
        token = self.name()
        high = {"SUB": 1, "FUNCTION": 2}[kind] | (0x80 if self.has("CDECL") else 0)
        alias = self.take().text if self.has("ALIAS") else ""
        high |= (len(alias) & 31) << 2
        given = self.parameters()
        self.has("STATIC")
        low = 0x80 | _SUFFIX_CODES[token.suffix] if token.suffix else 0
        words = [Ref(token.text, PROCEDURE if kind == "SUB" else 0), high << 8 | low, NONE if given is None else len(given)]
        return [Item(mnemonic, (), [*words, *(x for p in given or () for x in p), alias.encode("latin-1")])]


_TYPE_CODES = {v: k for k, v in TYPES.items()} | {"ANY": 0}
_SUFFIX_CODES = {v: k for k, v in TYPE_SUFFIX.items()}
_LISTED = {spelled: mnemonic for mnemonic, spelled in LISTS.items()}
_RULES: dict[str, Callable[[Parser], list[Item]]] = {}
#: Keywords whose own rule goes before their forms.
_RULES_FIRST: set[str] = set()


def pushed(text: str) -> Item:
    return Item("PUSH_STR", (), text.encode("latin-1", "replace"), b'"')


def rule(*words: str, first: bool = True):
    """Registers how statements that begin with the words are read."""

    def put(read):
        for w in words:
            _RULES[w] = read
            if first:
                _RULES_FIRST.add(w)
        return read

    return put


def _keyword(p: Parser) -> str:
    return p.take().word


@rule("REM", "'")
def _comment(p):
    return p.comment()


@rule("DATA")
def _data(p):
    p.at += 1
    return [Item("DATA", (), b"\0\0" + p.take().text.encode("latin-1", "replace") + b"\0")]


@rule("PRINT", "LPRINT", "WRITE")
def _print(p):
    word = _keyword(p)
    made = {"PRINT": [], "LPRINT": [Item("LPRINT")], "WRITE": [Item("WRITE_FILE")]}[word]
    if word == "WRITE" and p.over():
        return [*made, Item("PRINT_NEWLINE")]
    if p.word() == "#":
        made = [*made, *p.file_number(), Item("PRINT_FILE")]
        p.has(",")
    if signs := _separators(p):
        made.append(Item("PRINT_FUNC_SEMI" if signs[-1] == ";" else "PRINT_FUNC_COMMA"))
    if p.has("USING"):
        made = [*made, *p.expression(), Item("PRINT_USING")]
        p.has(";")
    while not (p.over() or p.word() == "ELSE"):
        made += p.expression()
        spaced = made[-1].mnemonic in ("TAB", "SPC")
        signs = _separators(p)
        if not signs:
            return [*made, Item("PRINT_ITEM")]
        if spaced:
            made.append(Item("PRINT_FUNC_SEMI" if signs[-1] == ";" else "PRINT_FUNC_COMMA"))
        else:
            made += [Item("PRINT_SEMI" if s == ";" else "PRINT_COMMA") for s in signs]
    return [*made, Item("PRINT_NEWLINE")]


def _separators(p) -> list[str]:
    found = []
    while p.word() in (";", ","):
        found.append(p.take().text)
    return found


@rule("IF")
def _if(p):
    p.at += 1
    made = p.expression()
    if p.has("GOTO"):
        return [*made, Item("IF_GOTO", (label(p.target()),)), *_else_after(p)]
    p.has("THEN")
    if p.over():
        return [*made, Item("IF_THEN_BLOCK", (0,))]
    if p.at_line_number():
        return [*made, Item("IF_THEN_GOTO", (label(p.target()),)), *_else_after(p)]
    return [*made, Item("IF_THEN_LINE", (0,))]


def _else_after(p) -> list[Item]:
    if not p.has("ELSE"):
        return []
    return [Item("ELSE_AFTER_LINE"), *([Item("ELSE_LINE", (label(p.target()),))] if p.at_line_number() else [])]


@rule("ELSE")
def _else(p):
    p.at += 1
    return [Item("ELSE", (0,)), *([Item("ELSE_LINE", (label(p.target()),))] if p.at_line_number() else [])]


@rule("NEXT")
def _next(p):
    p.at += 1
    if p.over():
        return [Item("NEXT_BARE", (NONE, NONE))]
    return [Item(m, o) for t in p.listed(p.name) for m, o in (("LOAD" + t.suffix, (Ref(t.text),)), ("NEXT", (NONE, Ref(t.text))))]


@rule("CASE")
def _case(p):
    p.at += 1
    if p.has("ELSE"):
        return [Item("CASE_ELSE")]

    def one():
        if p.has("IS"):
            sign = p.take().text
            return [*p.expression(), Item(CASE_IS[sign])]
        made = p.expression()
        return [*made, *p.expression(), Item("CASE_RANGE")] if p.has("TO") else [*made, Item("CASE")]

    return sum(p.listed(one), [])


@rule("END")
def _end(p):
    p.at += 1
    mnemonic = ENDS.get(p.word(), "END")
    p.at += mnemonic != "END"
    return [Item(mnemonic, tuple(NONE for _ in p.ops.named[mnemonic].operands))]


@rule("EXIT")
def _exit(p):
    p.at += 1
    return [Item({"DO": "EXIT_DO", "FOR": "EXIT_FOR"}.get(_keyword(p), "EXIT_SUB"), (NONE,))]


@rule("DIM", "REDIM", "STATIC", "COMMON", "SHARED")
def _declare(p):
    word = _keyword(p)
    made = [Item("SHARED")] if word != "SHARED" and p.has("SHARED") else []
    block = NONE
    if word == "COMMON" and p.has("/"):
        block = Ref(p.name().text)
        p.need("/")
    if word != "REDIM":
        made.append(Item("SHARED_TYPED" if word == "SHARED" else word, (NONE, block)[: 2 if word == "COMMON" else 1]))
    items = [] if p.over() else p.listed(lambda: p.declared("ARRAY" if word == "REDIM" else "ARRDECL"))
    return made + [x for item in items for x in (*item, *([Item("REDIM")] if word == "REDIM" else []))]


@rule("DEFINT", "DEFLNG", "DEFSNG", "DEFDBL", "DEFSTR")
def _deftype(p):
    code = 1 + ("DEFINT", "DEFLNG", "DEFSNG", "DEFDBL", "DEFSTR").index(_keyword(p))

    def span():
        first = p.name().word[0]
        return [first, p.name().word[0] if p.has("-") else first]

    return [deftype({i for a, b in p.listed(span) for i in range(ord(a) - 65, ord(b) - 64)}, code)]


def deftype(letters: Iterable[int], code: int) -> Item:
    """The letters as two masks: A to P from the top bit of one, Q to Z from the top bit of the other, which ends in the type."""
    bits = sum(1 << 31 - i for i in letters)
    return Item("DEFTYPE", (NONE, bits & 0xFFFF | code, bits >> 16))


@rule("CONST")
def _const(p):
    p.at += 1

    def one():
        token = p.name()
        p.need("=")
        return [*p.expression(), Item("STORE" + token.suffix, (Ref(token.text),))]

    return [Item("CONST"), *sum(p.listed(one), [])]


@rule("LET")
def _let(p):
    p.at += 1
    return [Item("LET"), *p.assignment_or_call()]


@rule("INPUT")
def _input(p):
    p.at += 1
    made, flags = _prompt(p)
    if flags is not None:
        made.append(Item("INPUT_PROMPT", (), bytes((flags, 0))))
    given = [] if p.over() else p.listed(p.expression)
    return [*made, *(x for v in given for x in (*v, Item("INPUT_VARS"))), Item("INPUT")]


def _prompt(p):
    """A channel, or a prompt and what its signs weigh: 4 a prompt, 2 a semicolon before it, 1 a comma after it."""
    weight = 2 * p.has(";")
    if p.word() == "#":
        made = [*p.file_number(), Item("INPUT_CHANNEL")]
        p.has(",")
        return made, None
    if p.tokens[p.at].kind != STRING:
        return [], weight
    made = [pushed(p.take().text)]
    comma = p.word() == ","
    if comma or p.word() == ";":
        p.at += 1
    return made, weight + 4 + comma


@rule("LINE")
def _line(p):
    p.at += 1
    if p.has("INPUT"):
        made, flags = _prompt(p)
        return [*made, *p.expression(), Item("INPUT_VARS_END", (flags or 0,))]
    made, shape, slots = p.points(), 0, []
    while p.has(","):
        named = p.word() in ("B", "BF")
        shape = {"B": 1, "BF": 2}[_keyword(p)] if named else shape
        slots.append([] if named or p.word() == "," or p.over() else p.expression())
    coloured, styled = bool(slots and slots[0]), bool(slots[2:3] and slots[2])
    return [*made, *sum(slots, []), Item("LINE" + "_STYLE" * styled + "_NOCOLOR" * (not coloured), (shape,))]


@rule("CIRCLE")
def _circle(p):
    p.at += 1
    made = p.point()
    p.need(",")
    made += p.expression()
    coloured = p.has(",") and not (p.word() == "," or p.over())
    if coloured:
        made += p.expression()
    for mark in ("CIRCLE_START", "CIRCLE_END", "CIRCLE_ASPECT"):
        if p.has(",") and not (p.word() == "," or p.over()):
            made += [*p.expression(), Item(mark)]
    return [*made, Item("CIRCLE_COLOR" if coloured else "CIRCLE")]


@rule("PAINT")
def _paint(p):
    p.at += 1
    made, given = p.point(), [p.expression() for _ in iter(lambda: p.has(","), False)]
    return [*made, *sum(given, []), *[Item("ARG")] * (2 - len(given)), Item("PAINT")]


@rule("VIEW", first=False)
def _view(p):
    p.at += 1
    mnemonic = "VIEW_SCREEN" if p.has("SCREEN") else "VIEW"
    made = []
    for sign in ("-", ""):
        p.need("(")
        made += p.expression()
        p.need(",")
        made += p.expression()
        p.need(")")
        if sign:
            p.need(sign)
    given = []
    while p.has(","):
        given.append([Item("ARG")] if p.word() == "," or p.over() else p.expression())
    return [*made, *sum(given, []), *[Item("ARG")] * (2 - len(given)), Item(mnemonic)]


@rule("GET", "PUT", first=False)
def _get_put(p):
    word = _keyword(p)
    made = p.points()
    p.need(",")
    made += p.place("a")
    if word == "GET":
        return [*made, Item("GET_GRAPHICS")]
    action = {v: k for k, v in PUT_ACTIONS.items()}[_keyword(p)] if p.has(",") else NONE
    return [*made, Item("PUT_GRAPHICS", (action,))]


@rule("LOCK", "UNLOCK")
def _lock(p):
    word = _keyword(p)
    made = p.file_number()
    if p.has(","):
        made += p.expression()
        if p.has("TO"):
            made += p.expression()
    return [*made, Item(word, (NONE,))]


@rule("READ")
def _read(p):
    p.at += 1
    return [x for v in p.listed(p.expression) for x in (*v, Item("READ"))]


@rule("FIELD")
def _field(p):
    p.at += 1
    made = [*p.file_number(), Item("FIELD_STMT")]
    while p.has(","):
        made += p.expression()
        p.need("AS")
        made += [*p.expression(), Item("FIELD_ITEM")]
    return made


@rule("ERASE")
def _erase(p):
    p.at += 1
    arrays = p.listed(p.whole_array)
    return [*sum(arrays, []), Item("ERASE", (len(arrays),))]


@rule("WIDTH", first=False)
def _width(p):
    p.at += 1
    made = p.expression()
    return [*made, *p.expression(), Item("WIDTH")] if p.has(",") else [*made, Item("ARG"), Item("WIDTH")]


@rule("OPEN")
def _open(p):
    p.at += 1
    made = p.expression()
    if p.has(","):
        rest = p.listed(p.file_number)
        return [*made, *sum(rest, []), Item("OPEN_MODE_STRING")]
    word = 0
    if p.has("FOR"):
        word = {v: k for k, v in OPEN_MODES.items()}[_keyword(p)]
    for lead, rows in ((("ACCESS",), OPEN_ACCESS), ((), OPEN_LOCKS)):
        for bits, clause in sorted(rows.items(), key=lambda row: -len(row[1])):
            if p.has(*lead, *clause.split()):
                word |= bits << 8
                break
    p.need("AS")
    made += p.file_number()
    if p.has("LEN"):
        p.need("=")
        return [*made, *p.expression(), Item("OPEN_RANDOM", (word,))]
    return [*made, Item("OPEN", (word,))]


@rule("CALL", "CALLS")
def _call(p):
    word, name = _keyword(p), p.name()
    given = p.arguments() or []
    return [*sum(given, []), Item(word, (len(given), Ref(name.text, PROCEDURE)))]


@rule("RUN")
def _run(p):
    if p.tokens[p.at + 1].kind == STRING:
        p.at += 2
        return [pushed(p.tokens[p.at - 1].text), Item("RUN_FILE")]
    mnemonic = "RUN_BARE" if p.over(1) else "RUN_LINE"
    p.at += 1
    return [Item(mnemonic, (label(p.target()),) if mnemonic == "RUN_LINE" else ())]


def _event(p) -> list[Item]:
    mnemonic = EVENTS[_keyword(p)]
    given = p.arguments()
    return [*sum(given or [], []), Item(EVENTS_OF_ONE.get(mnemonic, mnemonic) if given else mnemonic)]


@rule("ON")
def _on(p):
    p.at += 1
    if p.has("ERROR"):
        p.need("GOTO")
        return [Item("ON_ERROR", (label(p.target()),))]
    if p.word() in EVENTS:
        made = _event(p)
        p.need("GOSUB")
        return [*made, Item("ON_EVENT_GOSUB", (label(p.target()),))]
    made, word = p.expression(), _keyword(p)
    if word not in ("GOTO", "GOSUB"):
        raise ValueError(f"expected a jump, found {word!r}")
    return [*made, Item("ON_" + word, (), [label(t) for t in p.listed(p.target)])]


@rule("COM", "PEN", "TIMER", "STRIG", "UEVENT", "SIGNAL")
def _trap(p):
    begin, made = p.at, None
    made = _event(p)
    state = p.word()
    if state not in ("ON", "OFF", "STOP"):
        p.at = begin
        return p.assignment_or_call()
    p.at += 1
    return [*made, Item("EVENT_" + state)]


@rule("KEY", "PLAY")
def _key_play(p):
    word = p.word()
    if p.word(1) == "(" or word == "PLAY" and p.word(1) in ("ON", "OFF", "STOP"):
        return _trap(p)
    modes = {v: k for k, v in KEY_MODES.items()}
    if word == "KEY" and p.word(1) in modes and p.over(2):
        p.at += 2
        return [Item("KEY_MODE", (modes[p.word(-1)],))]
    return p.list_statement(word)


@rule("OPTION")
def _option(p):
    p.at += 1
    p.need("BASE")
    return [Item("OPTION_BASE" if p.take().text == "1" else "OPTION_BASE_0")]


@rule("DEF", first=False)
def _def(p):
    p.at += 1
    token, given = p.name(), p.parameters() or []
    low = 0x80 | _SUFFIX_CODES[token.suffix] if token.suffix else 0
    made = [Item("DEF_FN", (), [NONE, Ref(token.text), 3 << 8 | low, len(given), *(x for q in given for x in q)])]
    if p.word() != "=":
        return made
    column = p.take().at
    return [*made, *p.expression(), Item("DEF_FN_END_LINE", (2, column))]


@rule("DECLARE")
def _declare_procedure(p):
    p.at += 1
    kind = _keyword(p)
    if kind not in ("SUB", "FUNCTION"):
        raise ValueError(f"expected a procedure, found {kind!r}")
    return p.header(kind, "DECLARE")


@rule("SUB", "FUNCTION")
def _procedure(p):
    word = _keyword(p)
    return p.header(word, word)


def split_records(tokens: list[Token], records: frozenset[str]) -> list[Token]:
    """A name with points whose head is a record variable is that variable and its fields."""
    made = []
    for t in tokens:
        head, *fields = t.text.split(".")
        if t.kind == WORD and fields and head.lower() in records:
            made.append(Token(WORD, head, "", t.at))
            made += [x for f in fields for x in (Token("OP", ".", "", t.at), Token(WORD, f, "", t.at))]
            made[-1] = made[-1]._replace(suffix=t.suffix)
        else:
            made.append(t)
    return made


def parse_line(text: str, ops: Table, records: frozenset[str] = frozenset(), column: int = 0) -> list[Item]:
    """Instructions of a line without its label. column: where text begins in the line. ValueError for what can't be read."""
    tokens = [t._replace(at=t.at + column) for t in split_records(lex(text), records)]
    p, made = Parser(tokens, ops), []
    while p.tokens[p.at].kind != END:
        if p.has(":"):
            made += [Item("COLON")] if made else []
            continue
        found = p.statement()
        made += found
        if not (p.over() or p.word() == "ELSE" or found and found[-1].mnemonic in _OPEN_ENDED):
            raise ValueError(f"unexpected {p.tokens[p.at].text!r} after a statement")
    return made
