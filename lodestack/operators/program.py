"""Source text as program files: sections, lines as words, name table, image.

A file is one value of an Arrow batch, since names get their places in the order
in which the file mentions them. What can't be read as a statement is kept as text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, NAME
from ..sources.batches import slices, spread
from ..sources.opcodes import DEFAULT, Table, table
from .decode import END, ESCAPE_BIT, LABEL_BIT
from .lexer import SUFFIXES, WORD, Token, lex, number_type, number_value
from .render import DEFAULT_TYPE, deftype_letters
from .source import currency_words, records_of
from .statements import FRESH, NONE, NUMBERED, PROCEDURE, TYPE_SUFFIX, Item, Ref, deftype, forms_of, label, parse_line
from .structure import BUCKETS, BUCKETS_AT, FLAGS_AT, NAMES_AT, TABS

# Fixed values of the format: the bytes before the buckets (the code's place is filled in), the word after the end of the names, the
# free bytes after the names, kinds of sections and their trailers, and the words that begin included lines.
HEADER = bytes.fromhex("fc0001000c008101820106000102030405081010ffff2400ffff0000")
SIGNATURE_BYTES = 18
SELF_REF, SLACK = 82, 259
MODULE_TRAILER, PROCEDURE_TRAILER = 0x0102, 0x0C02
PROCEDURE_KIND, STATIC_BIT = 0x38, 0x80
INCLUDED, INCLUDED_ESCAPE, INCLUDED_LABEL, INCLUDED_LABEL_ESCAPE = 2, 3, 52, 53
#: Indents from here on have a word of their own.
WIDE_INDENT = 32


def standard_header(content: Column) -> Column:
    """Whether a file begins like those that the product itself writes."""
    return F.substring(content, 1, SIGNATURE_BYTES) == F.lit(HEADER[:SIGNATURE_BYTES])


class NameTable:
    """Names in order of first mention; a name's case doesn't count, and its first spelling stays."""

    def __init__(self):
        self.places: dict[tuple[int, str], int] = {}
        self.entries: list[tuple[int, bytes]] = []
        self.end = NAMES_AT - BUCKETS_AT

    def place(self, ref: Ref) -> int:
        key = ref.flags, ref.text.lower()
        if key not in self.places:
            body = int(ref.text).to_bytes(2, "little") if ref.flags == NUMBERED else ref.text.encode("latin-1", "replace")
            self.places[key] = self.end
            self.entries.append((ref.flags, body))
            self.end += 4 + len(body)
        return self.places[key]

    def image(self) -> bytes:
        """All entries in one chain, each linked to the next."""
        out, at = b"", NAMES_AT - BUCKETS_AT
        for k, (flags, body) in enumerate(self.entries):
            at += 4 + len(body)
            out += struct.pack("<HBB", at if k + 1 < len(self.entries) else 0, flags, len(body)) + body
        return out


def number_words(text: str, ops: Table) -> list[int]:
    """The words of a numeric literal."""
    kind, value, low = number_type(text), number_value(text), text.lower()
    if kind in ("single", "double"):
        raw = struct.pack("<f" if kind == "single" else "<d", value)
        return [ops.code("PUSH_SINGLE" if kind == "single" else "PUSH_DOUBLE"), *struct.unpack(f"<{len(raw) // 2}H", raw)]
    value = int(value)
    base = "" if low[0] != "&" else "_HEX" if low[1:2] == "h" else "_OCT"
    if kind == "long":
        return [ops.code(f"PUSH{base}_LONG"), value & 0xFFFF, value >> 16 & 0xFFFF]
    if not base and value <= 10:
        return [ops.code(f"PUSH_{value}")]
    return [ops.code(f"PUSH{base}" if base else "PUSH_INT"), value & 0xFFFF]


def payload_words(body: bytes, pad: bytes = b"\0") -> list[int]:
    """The length, then the bytes as words; what fills the last one isn't counted."""
    whole = body + pad * (len(body) % 2)
    return [len(body), *struct.unpack(f"<{len(whole) // 2}H", whole)]


def assemble(items: Iterable[Item], names: NameTable, ops: Table) -> list[int]:
    """Words of instructions. Operands that an instruction doesn't name are slots that a run fills in."""
    out: list[int] = []

    def word(x) -> int:
        return names.place(x) if isinstance(x, Ref) else x & 0xFFFF

    for item in items:
        if item.mnemonic == "PUSH":
            out += number_words(item.operands[0], ops)
            continue
        code = ops.code(item.mnemonic)
        out.append(code)
        given = iter(item.operands)
        for kind in ops.of(code).operands:
            if kind == "str":
                parts = [item.payload] if isinstance(item.payload, bytes) else item.payload
                body = b"".join(x if isinstance(x, bytes) else struct.pack("<H", word(x)) for x in parts)
                out += payload_words(body, item.pad)
            else:
                out.append(word(next(given, FRESH.get(item.mnemonic, NONE))))
    return out


# lines


def split_label(body: str, ops: Table) -> tuple[str | None, str]:
    """A label and what follows it. A number at the start is one, and a name before a colon that isn't a statement by itself."""
    digits = re.match(r"\d+(?!\w)", body)
    if digits:
        return digits[0], body[digits.end() :]
    name = re.match(NAME, body)
    if name and name[0][-1] not in SUFFIXES and body[name.end() : name.end() + 1] == ":":
        alone = [parts for _, parts in forms_of(ops).get(name[0].upper(), ()) if len(parts) == 1]
        if not alone and name[0].upper() not in ("ELSE", "RETURN", "NEXT", "END"):
            return name[0], body[name.end() + 1 :]
    return None, body


class Builder:
    """One program's name table, default types and words."""

    def __init__(self, text: str, ops: Table, included: dict[str, str] | None = None):
        self.lines = re.split(LINE_END, text)
        if self.lines and not self.lines[-1]:
            self.lines.pop()
        self.ops, self.names = ops, NameTable()
        self.included = {k.upper(): v for k, v in (included or {}).items()}
        self.numbers: dict[str, int] = {}
        self.records = records_of(self.lines)
        self.types = [DEFAULT_TYPE] * 26

    def image(self) -> bytes:
        if found := currency_words(self.lines):
            raise ValueError("only the later product can hold " + ", ".join(sorted(found)))
        sections = b"".join(self.section(*part) for part in split_sections(self.lines))
        names = self.names.image()
        head = bytearray(HEADER)
        head[FLAGS_AT] |= TABS * any(x.startswith("\t") for x in self.lines)
        struct.pack_into("<H", head, len(head) - 2, NAMES_AT + len(names) + SLACK - BUCKETS_AT)
        buckets = struct.pack("<H", NAMES_AT - BUCKETS_AT if names else 0) + bytes(2 * BUCKETS - 2)
        return bytes(head) + buckets + struct.pack("<2H", self.names.end, SELF_REF) + names + bytes(SLACK) + sections

    def set_types(self, items: list[Item]) -> None:
        for i in items:
            if i.mnemonic == "DEFTYPE":
                code, letters = deftype_letters(i.operands)
                for k in letters:
                    self.types[k] = code

    def record(self) -> list[Item]:
        """The default types in force as one record: the type that most letters have; the first letter decides among equals."""
        changed = [t for t in self.types if t != DEFAULT_TYPE]
        if not changed:
            return []
        code = max(dict.fromkeys(changed), key=changed.count)
        return [deftype([i for i, t in enumerate(self.types) if t == code], code)]

    def line(self, text: str) -> tuple[int, list[int], list[int], str | None]:
        """Header, label pair and escape, the statements' words, and the file that the line includes."""
        body, indent = text.lstrip(" \t"), source_column(text)
        column = indent
        mark, rest = split_label(body, self.ops)
        if mark is not None:
            cut = rest.lstrip(": ")
            indent, column, body = len(rest) - len(cut), len(body) - len(cut), cut
        head = [0xFFFF, self.names.place(label(mark))] if mark is not None else []
        flags = LABEL_BIT * (mark is not None) | ESCAPE_BIT * (indent >= WIDE_INDENT)
        head += [indent] * (indent >= WIDE_INDENT)
        header = (indent << 10 if indent < WIDE_INDENT else 0) | flags
        try:
            items = parse_line(body, self.ops, self.records, column)
            self.set_types(items)
            dotted = any(isinstance(x, Ref) and "." in x.text[1:] for i in items for x in [*i.operands, *(i.payload if isinstance(i.payload, list) else ())])
            words = assemble([*items, *([Item("DOTTED_NAME")] if dotted else [])], self.names, self.ops)
        except (ValueError, IndexError, KeyError, RecursionError):
            items, words = [], [self.ops.code("TEXT_LINE"), *payload_words(b"\0\0" + body.encode("latin-1", "replace"))]
        path = next((i.payload.decode("latin-1").rstrip("'\"").strip() for i in items if i.mnemonic == "META_INCLUDE"), None)
        return header, head, words, path

    def included_lines(self, path: str) -> Iterator[tuple[list[int], bool]]:
        """Lines of an included file, headed by the number of its name."""
        if path.upper() not in self.included:
            raise ValueError(f"include file not found: {path}")
        number = self.numbers.setdefault(path.upper(), len(self.numbers) + 1)
        for text in self.included[path.upper()].splitlines():
            header, head, words, _ = self.line(text)
            if header & LABEL_BIT:
                gap = head[2] if len(head) > 2 else header >> 10
                yield [INCLUDED, number, *([INCLUDED_LABEL_ESCAPE, *head[:2], gap] if gap > 1 else [INCLUDED_LABEL, *head]), *words], True
            else:
                yield [INCLUDED_ESCAPE if head else INCLUDED, number, *head, *words], False

    def section(self, lines: list[str], inherited: str | None, start: list[Token] | None) -> bytes:
        """A section with its trailer. start: tokens of the line that begins a procedure, None for the module."""
        if inherited is not None:
            self.set_types(parse_line(inherited.strip(), self.ops))
        words: list[int] = []
        count = included = 0
        if start is not None and (record := self.record()):
            words, count = [0, *assemble(record, self.names, self.ops)], 1
        links: list[int] = []  # where labelled lines keep the place of the next
        for text in lines:
            header, head, body, path = self.line(text)
            if header & LABEL_BIT:
                links.append(len(words) + 1)
            words += [header, *head, *body]
            count += 1
            for more, labelled in self.included_lines(path) if path is not None else ():
                if labelled:
                    links.append(len(words) + 3)
                words += more
                count, included = count + 1, included + 1
        for here, after in zip(links, [*links[1:], None], strict=False):
            words[here] = NONE if after is None else 2 * after
        body = struct.pack(f"<{len(words) + 2}H", *words, *END)
        chain = (2 * links[0] if links else NONE, NONE, NONE, NONE)
        if start is None:
            lead, kind = b"", MODULE_TRAILER
        else:
            keyword, name = start[0].word, start[1]
            self.names.place(Ref(name.text, PROCEDURE if keyword == "SUB" else 0))
            raw = name.text.encode("latin-1", "replace")
            static = STATIC_BIT * (start[-2].word == "STATIC")
            returns = {v: k for k, v in TYPE_SUFFIX.items()}.get(name.suffix, 0)
            lead = bytes((0, len(raw), 0)) + raw + bytes((1 if keyword == "SUB" else 2, returns, PROCEDURE_KIND | static))
            kind = PROCEDURE_TRAILER
        return lead + struct.pack("<H", len(body)) + body + struct.pack("<8H", *chain, count, included, 0, kind)


def source_column(line: str) -> int:
    """Column of the first character that is no blank, tabs to the next eighth."""
    return len(line[: len(line) - len(line.lstrip(" \t"))].expandtabs(8))


# sections


def _tokens(line: str) -> list[Token]:
    try:
        return lex(line)
    except ValueError:
        return []


def procedure_start(line: str) -> list[Token] | None:
    tokens = _tokens(line) if re.match(r"\s*[SsFf]", line) else []
    return tokens if len(tokens) > 2 and tokens[0].word in ("SUB", "FUNCTION") and tokens[1].kind == WORD and tokens[0].suffix == "" else None


def procedure_end(line: str) -> bool:
    words = [t.word for t in _tokens(line)[:2]] if re.match(r"\s*[Ee]", line) else []
    return words in (["END", "SUB"], ["END", "FUNCTION"])


def _note(line: str) -> str | None:
    """What a line that is only a comment says."""
    found = re.match(r"\s*(?:'|rem(?!\w))(.*)", line, re.IGNORECASE)
    return found[1].strip().upper() if found else None


def split_sections(lines: list[str]) -> list[tuple[list[str], str | None, list[Token] | None]]:
    """(lines, inherited default types, tokens of the first line of a procedure) of the module, then of each procedure.

    A procedure begins where SUB or FUNCTION does, unless the one before hasn't
    ended. Comments right above belong to it, metacommands don't; a line of
    default types above that is what it inherits.
    """
    starts, open_ = [], False
    for k, line in enumerate(lines):
        if not open_ and (tokens := procedure_start(line)):
            starts.append((k, tokens))
            open_ = True
        elif open_ and procedure_end(line):
            open_ = False
    parts: list[tuple[list[str], str | None, list[Token] | None]] = []
    begin, inherited, head = 0, None, None
    for k, tokens in [*starts, (len(lines), None)]:
        cut = k
        while tokens and cut > begin and (said := _note(lines[cut - 1])) is not None and not said.startswith(("$STATIC", "$DYNAMIC")):
            cut -= 1
        body, after = lines[begin:cut], None
        last = len(body)
        while last and not body[last - 1].strip():
            last -= 1
        if tokens and last and re.match(r"\s*def(int|lng|sng|dbl|str)(?!\w)", body[last - 1], re.IGNORECASE):
            after = body.pop(last - 1)
        parts.append((_without_separator(body, not parts and len(starts) > 0), inherited, head))
        begin, inherited, head = cut, after, tokens
    return parts


def _without_separator(body: list[str], module_of_many: bool) -> list[str]:
    """One blank line at the end only separates, and so does the $STATIC that closes a module."""
    if body and not body[-1].strip() and not (len(body) > 1 and not body[-2].strip()):
        body = body[:-1]
    last = len(body)
    while last and not body[last - 1].strip():
        last -= 1
    return body[: last - 1] if module_of_many and last and _note(body[last - 1]) == "$STATIC" else body


# whole files


def tokenize_text(text: str, ops: Table, included: dict[str, str] | None = None) -> bytes:
    return Builder(text, ops, included).image()


def tokenize(sources: DataFrame, opcodes: str = DEFAULT, texts: DataFrame | None = None) -> DataFrame:
    """sources: path, text. path, content (the image) and error. texts: path, text of files that may be included.

    An include is looked for beside its source and then, as the name alone, among
    texts; case aside. A file that only the later product can hold, or whose
    include isn't there, has an error.
    """
    ops = table(opcodes)

    @F.pandas_udf("content binary, error string")
    def build(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, bodies, found in slices(batches):
            made = []
            for text, keys, values in zip(names, bodies, found, strict=True):
                try:
                    made.append((tokenize_text(text or "", ops, dict(zip(keys, values, strict=True)) if keys is not None else None), None))
                except ValueError as e:
                    made.append((None, str(e)))
            yield pd.DataFrame(made, columns=["content", "error"])

    rows = spread(sources.select("path", "text"))
    if texts is None:
        rows = rows.withColumns({"keys": F.lit(None).cast("array<string>"), "values": F.lit(None).cast("array<string>")})
    else:
        rows = rows.join(_included(rows, texts), "path", "left")
    made = rows.select("path", build("text", "keys", "values").alias("r"))
    return made.select("path", "r.content", "r.error")


def _included(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """path, keys and values: names that a source includes, and their texts. Beside the source goes before the working folder."""
    pattern = r"(?i)\$INCLUDE\s*:\s*'?([^'\r\n]*)"
    asked = sources.select("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda x: F.upper(F.trim(x))))).alias("key"))
    beside = F.upper(F.concat(F.regexp_replace("path", "[^/]*$", ""), "key"))
    places = asked.select("path", "key", F.explode(F.array(F.struct(F.lit(0).alias("rank"), beside.alias("place")), F.struct(F.lit(1).alias("rank"), F.col("key").alias("place")))).alias("p")).select("path", "key", "p.*")
    files = texts.groupBy(F.upper("path").alias("place")).agg(F.min_by("text", "path").alias("text"))
    best = places.join(files, "place").groupBy("path", "key").agg(F.min_by("text", "rank").alias("text"))
    return best.groupBy("path").agg(F.collect_list(F.struct("key", "text")).alias("all")).select("path", F.col("all.key").alias("keys"), F.col("all.text").alias("values"))


def fmt(sources: DataFrame, opcodes: str = DEFAULT) -> DataFrame:
    """sources: path, text. path, before, after, changed and error: the text as the product would write it, procedures in their order."""
    from .render import Program
    from .source import would_change

    ops = table(opcodes)

    @F.pandas_udf("after string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            made = []
            for text in batch:
                try:
                    lines = Program.read(tokenize_text(text or "", ops), ops).text(ops, by_name=False)
                    made.append(("\n".join(x for x, _ in lines) + "\n", next((e for _, e in lines if e), None)))
                except ValueError as e:
                    made.append((None, str(e)))
            yield pd.DataFrame(made, columns=["after", "error"])

    rows = spread(sources.select("path", "text")).select("path", F.col("text").alias("before"), run("text").alias("r")).select("path", "before", "r.after", "r.error")
    return rows.withColumn("changed", F.col("after").isNotNull() & would_change(F.col("before"), F.col("after")))
