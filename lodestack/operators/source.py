"""Source text: tokens, expressions in reverse Polish, record variables, differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, numtype
from ..sources.batches import slices, spread
from ..sources.opcodes import DEFAULT, Table, table
from .lexer import END, STRING, WORD, Token, lex
from .statements import Item, Parser, Ref

TOKEN = "kind string, text string, suffix string, at int"
LEXED = f"tokens array<struct<{TOKEN.replace(' ', ':').replace(',:', ',')}>>, error string"
RPN = "words array<string>, error string"
_TOKEN_TYPES = (pa.string(), pa.string(), pa.string(), pa.int32())


def shown(item: Item) -> str:
    """An instruction as a word or a few."""
    if item.mnemonic == "PUSH":
        return f"PUSH {item.operands[0]}"
    if item.payload is not None:
        return f'{item.mnemonic} "{item.payload.decode("latin-1")}"'
    return " ".join([item.mnemonic, *(x.text if isinstance(x, Ref) else str(x) for x in item.operands)])


def reverse_polish(expression: str, ops: Table | None = None) -> list[str]:
    """An expression's operands and operators in the order of evaluation. Brackets that were written stay, as PAREN."""
    parser = Parser(lex(expression), ops or table())
    made = parser.expression()
    if parser.tokens[parser.at].kind != END:
        raise ValueError(f"unexpected {parser.tokens[parser.at].text!r}")
    return [shown(i) for i in made]


def _each(read, schema: str, first: str, text: str):
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = []
            for line in batch:
                try:
                    rows.append((None if line is None else read(line), None))
                except (ValueError, RecursionError) as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=[first, "error"])

    return run(text)


def lex_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """lines with tokens and error. A line that can't be split has no tokens; a null line has neither."""
    return spread(lines).withColumn("__l", _lexed(text)).select(*lines.columns, "__l.tokens", "__l.error")


def _lexed(text: str) -> Column:
    """Tokens and error of each line. The tokens of a slice are columns at once, since objects for each take longer than lexing."""

    @F.arrow_udf(LEXED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lines in slices(batch.to_pandas() for batch in batches):
            found, counts, errors = [], [], []
            for line in lines:
                made, error = [], None
                try:
                    made = None if line is None else lex(line)
                except (ValueError, RecursionError) as e:
                    made, error = None, str(e)
                found += made or ()
                counts.append(None if made is None else len(made))
                errors.append(error)
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TOKEN_TYPES, strict=True)] if found else [pa.array([], t) for t in _TOKEN_TYPES]
            ends = np.cumsum([0, *(n or 0 for n in counts)])
            offsets = pa.array(ends, pa.int32(), mask=np.array([n is None for n in counts] + [False]))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, Token._fields)), pa.array(errors, pa.string())], ["tokens", "error"])

    return run(text)


def token_rows(lexed: DataFrame, *keys: str) -> DataFrame:
    """A row per token, with the type that a number's form spells."""
    rows = lexed.select(*keys, F.posexplode("tokens").alias("token_no", "t")).select(*keys, "token_no", "t.*")
    return rows.withColumn("numtype", F.when(F.col("kind") == "NUMBER", numtype(F.col("text"))))


def parse_expressions(rows: DataFrame, text: str = "expression", opcodes: str = DEFAULT) -> DataFrame:
    """rows with words (reverse Polish) and error."""
    ops = table(opcodes)
    return spread(rows).withColumn("__r", _each(lambda s: reverse_polish(s, ops), RPN, "words", text)).select(*rows.columns, "__r.words", "__r.error")


# declarations, seen in tokens: comments and strings are no names there


def _code(line: str) -> list[Token]:
    """Tokens of a line without strings and comments; none where it can't be split."""
    try:
        return [t for t in lex(line) if t.kind not in (STRING, END)]
    except ValueError:
        return []


def defined_type(line: str) -> str | None:
    """The type that a TYPE line begins to define."""
    return _defined(_code(line))


def _defined(code: list[Token]) -> str | None:
    first = code[:2]
    return first[1].text.lower() if len(first) == 2 and first[0].word == "TYPE" and first[1].kind == WORD else None


def declared_types(line: str) -> Iterator[tuple[str, str]]:
    """(name, type) wherever a name, with or without brackets after it, is declared AS a type."""
    return _declared(_code(line))


def _declared(tokens: list[Token]) -> Iterator[tuple[str, str]]:
    for k, t in enumerate(tokens):
        if t.word != "AS" or not 0 < k < len(tokens) - 1 or tokens[k + 1].kind != WORD:
            continue
        at, depth = k - 1, 0
        while at >= 0 and (depth or tokens[at].word == ")"):
            depth += {")": 1, "(": -1}.get(tokens[at].word, 0)
            at -= 1
        if at >= 0 and tokens[at].kind == WORD:
            yield tokens[at].text.lower(), tokens[k + 1].text.lower()


def records_of(lines: Iterable[str]) -> frozenset[str]:
    """Variables of the types that the lines define."""
    codes = [_code(line) for line in lines]
    types = {x for code in codes if (x := _defined(code))}
    return frozenset(name for code in codes if types for name, kind in _declared(code) if kind in types)


def record_variables(lines: DataFrame) -> DataFrame:
    """lines: path, line. path, name (lower case) of variables declared as a type that the same file defines."""

    @F.pandas_udf("array<struct<name:string,kind:string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches):
            made = []
            for code in (_code(x or "") for x in batch):
                own = _defined(code)
                made.append([{"name": n, "kind": k} for n, k in _declared(code)] + ([] if own is None else [{"name": None, "kind": own}]))
            yield pd.Series(made, dtype=object)

    # most lines say neither; the built-in filter keeps them from Python
    rows = spread(lines.where(F.upper("line").contains("TYPE") | F.upper("line").contains("AS")).select("path", "line"))
    kinds = rows.select("path", F.inline(found("line"))).groupBy("path", "kind").agg(F.collect_set("name").alias("names"), F.count_if(F.col("name").isNull()).alias("defined"))
    return kinds.where("defined > 0").select("path", F.explode("names").alias("name")).distinct()


def currency_words(lines: Iterable[str]) -> set[str]:
    """What in a program only the later product can hold; a program that defines a type of that name means its own type."""
    words = [[t.word for t in _code(line)] for line in lines if "CUR" in line.upper()]
    pairs = {p for line in words for p in zip(line, line[1:], strict=False)}
    found = {"DEFCUR"} if any("DEFCUR" in line for line in words) else set()
    return found | ({"AS CURRENCY"} if ("AS", "CURRENCY") in pairs and ("TYPE", "CURRENCY") not in pairs else set())


def pds_words(lines: DataFrame) -> DataFrame:
    """lines: path, line. path, word: what only the later product can hold, outside comments and strings, line by line."""

    @F.pandas_udf("array<string>")
    def seen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches):
            made = []
            for line in batch:
                words = [t.word for t in _code(line or "")]
                pairs = set(zip(words, words[1:], strict=False))
                made.append([*["DEFCUR"] * ("DEFCUR" in words), *["AS CURRENCY"] * (("AS", "CURRENCY") in pairs), *["OWN"] * (("TYPE", "CURRENCY") in pairs)])
            yield pd.Series(made, dtype=object)

    rows = lines.where(F.upper("line").contains("CUR")).select("path", F.explode(seen("line")).alias("word")).groupBy("path").agg(F.collect_set("word").alias("all"))
    kept = F.filter("all", lambda w: (w == "DEFCUR") | (w == "AS CURRENCY") & ~F.array_contains("all", "OWN"))
    return rows.select("path", F.explode(kept).alias("word"))


def would_change(before: Column, after: Column) -> Column:
    """Whether two texts differ in lines; how the lines end doesn't count."""
    lines = lambda t: F.when(t == "", "").otherwise(F.regexp_replace(F.concat(F.regexp_replace(t, LINE_END, "\n"), F.lit("\n")), "\n\n\\z", "\n"))
    return ~lines(before).eqNullSafe(lines(after))


def fmt_diff(rows: DataFrame) -> DataFrame:
    """rows: path, before, after. path, diff: a unified difference, empty where nothing changes."""

    def run(batches):
        for batch in batches:
            made = ["\n".join(difflib.unified_diff((b or "").splitlines(), (a or "").splitlines(), p, p + " formatted", lineterm="")) for p, b, a in zip(batch["path"], batch["before"], batch["after"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "diff": made})

    return rows.select("path", "before", "after").mapInPandas(run, "path string, diff string")
