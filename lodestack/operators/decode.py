"""Token streams as lines and instructions.

A section is decoded in one piece, since where an instruction begins depends on
all before it; sections are rows of Arrow batches, so they spread over tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.batches import slices
from ..sources.opcodes import DEFAULT, Table, table

# Fixed values of the format: the end of a stream; what follows the header of an included line; words that an operand takes; the mark of a run.
END = (9, 8)
INCLUDED = {2: ("file",), 3: ("file", "escape"), 52: ("label_offset", "label_ref"), 53: ("label_offset", "label_ref", "escape")}
ESCAPE_BIT, LABEL_BIT, FLAG_BITS = 1, 4, 1023
OPERAND_WORDS = {"u16": 1, "ref": 1, "argc": 1, "u32": 2, "f32": 2, "f64": 4}
RUN_MARK = 13

INSTR = "struct<instr_no:int,offset:int,code:int,mnemonic:string,operands:array<int>,payload:binary>"
LINE = f"struct<line_no:int,offset:int,header:int,indent:int,label_offset:int,label_ref:int,included:boolean,include_ref:int,instrs:array<{INSTR}>>"
SCHEMA = f"lines array<{LINE}>, truncated boolean"


def is_header(word: int) -> bool:
    return word in INCLUDED or not word & FLAG_BITS & ~(ESCAPE_BIT | LABEL_BIT)


class Short(Exception):
    """The stream ends within a line."""


class Stream:
    def __init__(self, body: bytes):
        self.body, self.words, self.at = body, struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2]), 0

    def over(self) -> bool:
        return self.at >= len(self.words) or self.words[self.at : self.at + 2] == END

    def take(self, n: int = 1) -> tuple[int, ...]:
        if self.at + n > len(self.words):
            raise Short
        self.at += n
        return self.words[self.at - n : self.at]

    def head(self, line: dict) -> None:
        """The header's further words: for an ordinary line the label pair, then the escape, as its bits say."""
        word = line["header"]
        fields = INCLUDED.get(word) or ("label_offset", "label_ref") * bool(word & LABEL_BIT) + ("escape",) * bool(word & ESCAPE_BIT)
        values = dict(zip(fields, self.take(len(fields)), strict=True))
        line |= {"included": word in INCLUDED, "include_ref": values.get("file"), "label_offset": values.get("label_offset"), "label_ref": values.get("label_ref")}
        if (escape := values.get("escape")) is not None:
            line["indent"] = escape if escape & FLAG_BITS else escape >> 10

    def instr(self, instrs: list, opcodes: Table, later: bool) -> None:
        offset, (code,) = self.at * 2, self.take()
        op = opcodes.of(code, later)
        mnemonic, kinds = (op.mnemonic, op.operands) if op else (None, ())
        found = {"instr_no": len(instrs), "offset": offset, "code": code, "mnemonic": mnemonic, "operands": [], "payload": None}
        instrs.append(found)
        for kind in kinds:
            if kind == "str":
                (size,) = self.take()
                found["payload"] = self.body[self.at * 2 :][:size]
                self.at += (size + 1) // 2
            else:
                found["operands"] += self.take(OPERAND_WORDS[kind])


def decode(body: bytes, opcodes: Table, later: bool = False) -> tuple[list[dict], bool]:
    """Lines of a stream, and whether it ends before its end mark within a line. Words without an opcode have no operands."""
    stream, lines = Stream(body), []
    try:
        while not stream.over():
            offset, (word,) = stream.at * 2, stream.take()
            line = {"offset": offset, "header": word, "indent": word >> 10, "label_offset": None, "label_ref": None, "included": False, "include_ref": None, "instrs": []}
            lines.append(line)
            stream.head(line)
            while not stream.over() and not is_header(stream.words[stream.at]):
                stream.instr(line["instrs"], opcodes, later)
        short = False
    except Short:
        short = True
    # an included line with a label has an empty header before it
    kept = [a for a, b in zip(lines, [*lines[1:], None], strict=False) if not (b and a["included"] and not a["instrs"] and a["label_ref"] is None and b["header"] in (52, 53))]
    return [{"line_no": i} | line for i, line in enumerate(kept)], short


def expand_runs(payload: bytes | None) -> bytes | None:
    """Runs in stored text: mark, count, byte. A mark too near the end is itself."""
    if payload is None:
        return None
    made, at = bytearray(), 0
    while (mark := payload.find(RUN_MARK, at)) >= 0 and mark + 2 < len(payload):
        made += payload[at:mark] + payload[mark + 2 : mark + 3] * payload[mark + 1]
        at = mark + 3
    return bytes(made + payload[at:])


def decode_sections(sections: DataFrame, opcodes: str = DEFAULT) -> DataFrame:
    """sections: as of parse_sections. opcodes: the file of the opcode table, which goes to every task with the function.

    Returns path, section, lines, truncated and in_sync (as many lines as the
    trailer says).
    """
    ops = table(opcodes)

    @F.pandas_udf(SCHEMA)
    def decoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, versions in slices(batches):
            yield pd.DataFrame([decode(b or b"", ops, v == 2) for b, v in zip(bodies, versions, strict=True)], columns=["lines", "truncated"])

    found = sections.where("body is not null").select("path", "section", "trailer", decoded("body", "version").alias("d"))
    return found.select("path", "section", "d.lines", "d.truncated", (~F.col("d.truncated") & (F.size("d.lines") == F.col("trailer.line_count"))).alias("in_sync"))


def words(data: Column) -> Column:
    """Bytes as unsigned little-endian words; a last odd byte is left out."""
    at = F.when(F.octet_length(data) > 1, F.sequence(F.lit(1), F.octet_length(data) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.conv(F.concat(F.hex(F.substring(data, k + 1, F.lit(1))), F.hex(F.substring(data, k, F.lit(1)))), 16, 10).cast("int"))


def line_rows(decoded: DataFrame) -> DataFrame:
    return decoded.select("path", "section", F.explode("lines").alias("l")).select("path", "section", "l.*")


def instr_rows(decoded: DataFrame) -> DataFrame:
    """path, section, line_no and the fields of each instruction; mnemonic is null for unknown codes."""
    return line_rows(decoded).select("path", "section", "line_no", F.explode("instrs").alias("i")).select("path", "section", "line_no", "i.*")


def number(operands: Column, n: int) -> Column:
    """Unsigned value of the first n words of operands, the lowest first."""
    return reduce(lambda a, i: a + F.get(operands, i).cast("bigint") * (1 << 16 * i), range(1, n), F.get(operands, 0).cast("bigint"))
