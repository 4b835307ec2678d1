"""Source to program files and back: what comes out is what went in, and what the words in between are."""

import struct

import pytest
from pyspark.sql import functions as F

from lodestack.operators import program, render, source, statements
from lodestack.operators.lexer import lex, number_type
from lodestack.plans import commands
from lodestack.sources.opcodes import DEFAULT, read_rows, table

OPS = table()


def read(text, included=None):
    return render.Program.read(program.tokenize_text(text, OPS, included), OPS)


def round_trip(text, **how):
    return [x for x, _ in read(text).text(OPS, **how)]


def mnemonics(text):
    return [i.mnemonic for i in statements.parse_line(text, OPS)]


SAME = """
A% = B% + C% * 2
PRINT "hi"; X, Y
PRINT #1, X
PRINT USING "##"; A; B
PRINT #2, USING "##"; A
PRINT TAB(5); X
PRINT TAB(5); , X
PRINT ; X
LPRINT "x"; Y
WRITE #1, A$, 2
FOR I = 1 TO 10 STEP 2
NEXT I
NEXT
IF A > 1 THEN PRINT "x"
IF A THEN 100 ELSE 200
IF A GOTO Out
IF A THEN
IF A = 1 THEN B = 2 ELSE B = 3
IF A THEN PRINT 1 ELSE 300
ELSEIF A > B THEN
DO WHILE A < 3
LOOP UNTIL X = 2
SELECT CASE X
CASE 1, 2, 7
CASE 1 TO 3
CASE IS <> 4
GOSUB 100
ON X GOTO A, B, 300
ON ERROR GOTO 0
ON TIMER(5) GOSUB Tick
ON PEN GOSUB Tick
TIMER ON
KEY(1) STOP
KEY LIST
KEY 1, "x"
PLAY ON
DIM A(10) AS INTEGER
DIM A(1 TO 10, 5), B$
DIM SHARED X AS STRING * 8
REDIM A(5), B(1 TO 6)
COMMON SHARED /Blk/ A, B()
STATIC X%
CONST TRUE = -1, FALSE = 0
CALL Foo(1, 2)
Foo 1, 2
DECLARE SUB Foo CDECL ALIAS "far" (A%, SEG B() AS INTEGER, C AS ANY)
DECLARE FUNCTION Bar& (BYVAL X%)
DECLARE SUB NoList
DEF FnDouble# (X) = X * 2
DEF SEG = &HB800
DEFINT A-C, X-Z
DATA 1, 2, "three: 3"
READ A, B$
OPEN "f" FOR RANDOM ACCESS READ WRITE LOCK WRITE AS #1 LEN = 20
OPEN "f" FOR INPUT SHARED AS 3
OPEN "R", #1, "F", 128
CLOSE #1, #2
INPUT "name"; A$
INPUT ; "name", A$, B
INPUT #1, X
LINE INPUT "x"; A$
LINE INPUT #1, A$
LINE -(3, 4)
LINE (1, 2)-STEP(3, 4), , B
LINE (1, 2)-(3, 4), 5, B, &HFF
LINE (1, 2)-(3, 4), , , &HFF
CIRCLE (1, 2), 3
CIRCLE STEP(1, 2), 3, 4, 0, 2, .5
CIRCLE (1, 2), 3, , 0
CIRCLE (1, 2), 3, 4, , , .5
PRESET (1, 2)
PAINT (1, 2), 3, 4
PAINT (1, 2)
VIEW (1, 2)-(3, 4), , 6
VIEW SCREEN (1, 2)-(3, 4)
VIEW PRINT 1 TO 5
WINDOW SCREEN (0, 0)-(1, 1)
GET (1, 2)-(3, 4), Buf
PUT (1, 2), Buf(3), XOR
GET #1, 5, X
PUT #1, , X
PUT #1, 5
LOCATE , , 1
COLOR 7, , 0
CLS 2
WIDTH 80
WIDTH #1, 40
WIDTH LPRINT 80
FIELD #1, 10 AS A$, 5 AS B$
RSET R.F = "x"
MID$(A$, 2, 3) = B$
ERASE A, B
X = LEFT$(A$, 2) + MID$(B$, 3) + INPUT$(2, #1)
X = UBOUND(A, 2) + LBOUND(B)
X = -X ^ 2 MOD (3 \\ Y)
X = NOT A AND B OR C XOR D EQV E IMP F
X = 1.5 + 2# + 3! + 100000 + &HFF + &HFFFF& + &O17 + 1E+20 + .25 + 1.5D+100
X = INSTR(2, A$, B$) + INSTR(A$, B$) + RND + RND(1)
A(3, I) = F(1)
LOCK #1, 1 TO 5
PALETTE USING A(0)
OPTION BASE 1
RUN "x"
RUN 100
RESUME NEXT
RESUME Again
LET A = 1
A = 1: B = 2 ' note
' just
REM x
' $DYNAMIC
REM $STATIC
10 PRINT "n"
30     PRINT I
Lab: PRINT "l"
Loop.Top:  GOTO Loop.Top
Skip:
    X = 1                ' far away
                                       X = 1
CLS : PRINT : PRINT 1
X = 1:
""".strip("\n").split("\n")


@pytest.mark.parametrize("line", SAME)
def test_a_line_comes_back(line):
    assert round_trip(line) == [line, ""]
    assert not any(i["mnemonic"] == "TEXT_LINE" for x in read(line).sections[0]["lines"] for i in x["instrs"])


@pytest.mark.parametrize(
    "before,after",
    [
        ("print 1", "PRINT 1"), ("dim shared n as long", "DIM SHARED n AS LONG"), ("for i=1 to 3", "FOR i = 1 TO 3"), ("if a mod 2=0 then print a", "IF a MOD 2 = 0 THEN PRINT a"),
        ('print "x";n$', 'PRINT "x"; n$'), ("sub hi(n$)", "SUB hi (n$)"), ("case is=>3", "CASE IS >= 3"), ("x=1E3+180!", "x = 1000! + 180!"), ("open f$ for append as 1", "OPEN f$ FOR APPEND AS 1"),
    ],
)
def test_one_spelling(before, after):
    assert round_trip(before)[0] == after


def test_what_is_no_statement_stays_text():
    for line in ("this is not basic (((", "X = {", "PRINT USING", "FOR = 3 TO"):
        assert round_trip(line)[0] == line
    assert [i["mnemonic"] for i in read("{").sections[0]["lines"][0]["instrs"]] == ["TEXT_LINE"]


@pytest.mark.parametrize(
    "line,want",
    [
        ("A = 16", "PUSH STORE"), ("A(1) = 2", "PUSH PUSH ARRSET"), ("R(N).F = 63", "PUSH LOAD ARRAY FIELD_SET"), ("Go.On", "CALL_IMPLICIT"), ("LOCATE , , 1", "ARG_OMITTED ARG_OMITTED ARG PUSH LOCATE"),
        ('IOCTL #1, "M"', "PUSH FILE_NUMBER PUSH_STR IOCTL"), ("FOR I = 1 TO 2", "LOAD PUSH PUSH FOR"), ("CLS", "ARG CLS"), ("LINE (0, 0)-(1, 1), 1", "PUSH PUSH COORD PUSH PUSH COORD_TO PUSH LINE"),
        ("DIM SHARED A(1)", "SHARED DIM DIM_ARRAY PUSH ARRDECL"), ("REDIM A(1)", "DIM_ARRAY PUSH ARRAY REDIM"), ("NEXT I, J", "LOAD NEXT LOAD NEXT"), ("UEVENT ON", "UEVENT EVENT_ON"), ("fre = 1", "PUSH STORE"),
        ("PRINT FRE(0)", "PUSH FRE PRINT_ITEM"), ("DATE$ = \"x\"", "PUSH_STR DATE$_SET"), ("PRINT DATE$", "DATE$ PRINT_ITEM"), ("ADD + 1", "PUSH CALL_IMPLICIT"), ("X = GE * 2 + SLEEP", "LOAD PUSH MULTIPLY LOAD ADD STORE"),
    ],
)
def test_instructions(line, want):
    assert " ".join(mnemonics(line)) == want


@pytest.mark.parametrize("text,want", [("ADD + 1", "LOAD ADD,PUSH 1,ADD"), ("CINT(X)", "LOAD X,CINT"), ("UBOUND(A)", "ARRAY 32768 A,UBOUND"), ("MID$(A$, 2)", "LOAD$ A,PUSH 2,MID$_REST"), ("INPUT$(1)", "PUSH 1,INPUT$_ONE"), ("RND(1) + RND", "PUSH 1,RND_SEED,RND,ADD"), ("FOO()", "ARRAY 0 FOO"), ("#1", "PUSH 1,FILE_NUMBER"), ("PAREN", "LOAD PAREN"), ("LEFT$", "LOAD$ LEFT")])
def test_expressions_by_spelling_and_arguments(text, want):
    assert ",".join(source.reverse_polish(text)) == want


@pytest.mark.parametrize("text,kind", [("1", "integer"), ("70000", "long"), (".01", "single"), ("1.5D+10", "double"), ("1.5E+10", "single"), ("100#", "double"), ("100&", "long"), ("&HFF", "integer"), ("&HFFFFF", "long"), ("&O777", "integer")])
def test_number_types(text, kind):
    assert number_type(text) == kind and lex(text)[0].text == text


@pytest.mark.parametrize("value,text", [(1.00794, "1.00794"), (2.5, "2.5"), (0.2, ".2"), (180.0, "180!"), (1e20, "1E+20"), (1e-5, "1E-5"), (0.001, ".001"), (-0.5, "-.5"), (0.0, "0!"), (16777216.0, "16777216!")])
def test_singles(value, text):
    assert render.format_single(struct.unpack("<2H", struct.pack("<f", value))) == text


@pytest.mark.parametrize("value,text", [(2.0, "2#"), (3.141592653, "3.141592653#"), (1e100, "1D+100"), (0.1, ".1#"), (123456789012.0, "123456789012#")])
def test_doubles(value, text):
    assert render.format_double(struct.unpack("<4H", struct.pack("<d", value))) == text


def test_signatures():
    assert render.parse_signature(b"") is None and render.parse_signature(struct.pack("<3H", 1, 0, 5)) is None
    sig = render.parse_signature(struct.pack("<3H", 1, 0x0282, 0xFFFF))
    assert (sig.listed, sig.suffix, sig.is_function, sig.params) == (False, "&", True, [])
    later = render.parse_signature(struct.pack("<7H", 1, 0x0100, 1, 9, 512, 5, 0), later=True)
    assert later.params == [(9, 512, 5)]


def test_procedures_defaults_and_order():
    text = "DEFINT A-Z\nDECLARE SUB Zoo (X)\nZoo 1\n\nDEFSNG A-B\n' about it\nSUB Zoo (X) STATIC\n  X = 1\nEND SUB\n\nFUNCTION Ant$ (Y)\n  Ant$ = \"x\"\n  EXIT FUNCTION\nEND FUNCTION\n"
    p = read(text)
    assert [(s["name"], s["proc_kind"], s["return_type"], s["kind_byte"]) for s in p.sections] == [(None, None, None, None), ("Zoo", 1, 0, 0xB8), ("Ant", 2, 5, 0x38)]
    assert all(not s["truncated"] and len(s["lines"]) == s["trailer"]["line_count"] for s in p.sections)
    assert round_trip(text) == [
        "DEFINT A-Z", "DECLARE SUB Zoo (X)", "Zoo 1", "", "DEFSNG A-B", "FUNCTION Ant$ (Y)", '  Ant$ = "x"', "  EXIT FUNCTION", "END FUNCTION", "", "' about it", "SUB Zoo (X) STATIC", "  X = 1", "END SUB", "",
    ]
    assert round_trip(text, by_name=False)[4:7] == ["DEFSNG A-B", "' about it", "SUB Zoo (X) STATIC"]
    assert render.deftype_delta([1] * 26, [1 if i in (2, 17) else 3 for i in range(26)]) == ["DEFSNG A-B, D-Q, S-Z"]


def test_dynamic_modules_end_in_static():
    assert round_trip("REM $DYNAMIC\nPRINT 1\n\nREM $STATIC\nSUB A\nEND SUB")[-5:] == ["", "REM $STATIC", "SUB A", "END SUB", ""]


def test_a_name_has_one_spelling_and_records_have_fields():
    assert round_trip("Total = 1\ntotal = 2\nTOTAL = 3") == ["Total = 1", "Total = 2", "Total = 3", ""]
    p = read("TYPE T\nN AS INTEGER\nEND TYPE\nDIM R AS T\nR.N = 1\nQ.N = 1")
    said = [[i["mnemonic"] for i in x["instrs"]] for x in p.sections[0]["lines"]]
    assert said[4] == ["PUSH_1", "LOAD", "FIELD_SET"] and said[5] == ["PUSH_1", "STORE", "DOTTED_NAME"]
    assert [x for x, _ in p.text(OPS)][:3] == ["TYPE T", "N AS INTEGER", "END TYPE"]


def test_labels_are_chained():
    s = read("A: X = 1\nY = 2\n10 X = 3\nB:\n").sections[0]
    links = [x["label_offset"] for x in s["lines"] if x["label_ref"] is not None]
    at = [x["offset"] for x in s["lines"] if x["label_ref"] is not None]
    assert s["trailer"]["h0"] == at[0] + 2 and links == [at[1] + 2, at[2] + 2, 0xFFFF]


def test_included_lines_are_kept_and_not_shown():
    p = read("PRINT 1\n'$INCLUDE: 'lib.bi'\nPRINT 2", {"LIB.BI": "A = 1\nHere: B = 2\n"})
    s = p.sections[0]
    assert (s["trailer"]["line_count"], s["trailer"]["included_count"], [x["included"] for x in s["lines"]]) == (5, 2, [False, False, True, True, False])
    assert [x for x, _ in p.text(OPS)] == ["PRINT 1", "'$INCLUDE: 'lib.bi'", "PRINT 2", ""]
    with pytest.raises(ValueError, match="not found"):
        read("'$INCLUDE: 'gone.bi'")


def test_images_have_the_standard_header(spark):
    data = program.tokenize_text("\tX = 1", OPS)
    row = spark.createDataFrame([(data,)], "c binary").select(program.standard_header(F.col("c"))).first()
    assert row[0] and data[19] & 0x80 and round_trip("\tX = 1")[0] == "\tX = 1"


def test_the_later_products_source_is_refused(spark):
    rows = {r.path: (r.content, r.error) for r in program.tokenize(spark.createDataFrame([("a", "DIM X AS CURRENCY"), ("b", "X = 1"), ("c", None), ("d", "'$INCLUDE: 'x.bi'")], "path string, text string")).collect()}
    assert rows["a"][0] is None and "CURRENCY" in rows["a"][1] and rows["b"][1] is None and rows["c"][1] is None and "not found" in rows["d"][1]


def test_includes_beside_the_source_come_first(spark):
    sources = spark.createDataFrame([("/d/m.bas", "'$INCLUDE: 'a.bi'"), ("/e/m.bas", "'$include: 'A.BI'")], "path string, text string")
    texts = spark.createDataFrame([("/d/A.BI", "X = 1\nY = 1"), ("a.bi", "X = 2")], "path string, text string")
    made = {r.path: render.Program.read(bytes(r.content), OPS).sections[0]["trailer"]["included_count"] for r in program.tokenize(sources, texts=texts).collect()}
    assert made == {"/d/m.bas": 2, "/e/m.bas": 1}


FINDINGS = [
    ("TRON", "TRON"), ("PRINT FRE(0)", "FRE"), ("PRINT ERDEV", "ERDEV"), ('IOCTL #1, "M"', "IOCTL"), ("CALLS Ext(3)", "CALLS"), ('DATE$ = "x"', "DATE$ ="), ("WIDTH LPRINT 80", "WIDTH LPRINT"), ('LPRINT "x"', "LPRINT"), ('CHAIN "o"', "CHAIN"),
    ("UEVENT ON", "UEVENT"), ("DEF FnD (X) = X * 2", "DEF FN"), ("CALL ABSOLUTE(0)", "CALL ABSOLUTE"), ('OPEN "LPT1:" FOR OUTPUT AS #1', "OPEN LPT1:"), ('OPEN "COM2:9600" FOR RANDOM AS #1', "OPEN COM:"),
    ('OPEN "CONFIG.DAT" FOR INPUT AS #1', None), ("fre = 1: PRINT fre", None), ('PRINT "TRON"', None), ("X = 1 ' CALLS", None), ("PRINT DATE$", None), ("TRON: TRON", "TRON"),
]


def test_findings_of_files(spark):
    sources = spark.createDataFrame([(str(k), text) for k, (text, _) in enumerate(FINDINGS)], "path string, text string")
    found = {}
    for r in commands.lint(spark, program.tokenize(sources)).collect():
        found.setdefault(int(r.path), []).append(r.keyword)
    assert found == {k: [want] for k, (_, want) in enumerate(FINDINGS) if want}
    assert spark.table("lodestack_lint").count() == len(found)


def test_commands(spark, tmp_path):
    text = "DECLARE SUB S (A%)\n10 S 1 ' n\nSUB S (A%)\nEND SUB\n"
    (tmp_path / "m.BAS").write_bytes(program.tokenize_text(text, OPS))
    (tmp_path / "bad.BAS").write_bytes(b"\xfc\x07")
    where = str(tmp_path)
    assert {(r.section, r.name, r.n_subs) for r in commands.dump(spark, where).collect() if r.error is None} == {(0, None, 1), (1, "S", 1)}
    assert [(r.kind, r.name) for r in commands.names(spark, where).collect() if r.error is None] == [("sub", "S"), ("name", "A"), ("line", "10")]
    assert commands.names(spark, where, procedures=True).where("error is null").count() == 1
    assert [r.name for r in commands.sections(spark, where, index=1).collect()] == ["S"] and commands.sections(spark, where, with_bytes=True).where("off = 0").count() == 2
    said = [(r.section, r.line_no, r.instructions) for r in commands.lines(spark, where).collect()]
    assert said[1] == (0, 1, "PUSH_1 CALL_IMPLICIT 0x0001 S REM ' n'")
    assert commands.stats(spark, where).where("file = 'TOTAL'").first().unidentified == 0
    made = {r.path.rsplit("/", 1)[1]: (bytes(r.content).decode("latin-1"), r.has_error) for r in commands.detok(spark, where).collect()}
    assert made["m.BAS"] == ("DECLARE SUB S (A%)\r\n10 S 1 ' n\r\n\r\nSUB S (A%)\r\nEND SUB\r\n\r\n", False) and made["bad.BAS"][1]
    assert {r.kind for r in commands.triage_files(spark, where).collect()} == {"QuickBASIC 4.5"}
    sources = spark.createDataFrame([("a", "print 1"), ("b", "PRINT 1\n\n")], "path string, text string")
    assert {r.path: (r.changed, bool(r["diff"])) for r in commands.fmt(spark, sources).collect()} == {"a": (True, True), "b": (False, False)}
    assert commands.tok(spark, sources).where("error is null").count() == 2
    commands.register(spark)
    assert spark.sql("select render_program(tokenize_basic('print  1')) as t").first().t == "PRINT 1\n"


def test_a_line_number_beyond_a_word_is_a_line(spark):
    sources = spark.createDataFrame([("a", "70000 GOTO 70000\n10 GOTO Far\nFar: X = 1\n")], "path string, text string")
    found = commands.names(spark, program.tokenize(sources)).collect()
    assert {(r.kind, r.name) for r in found} == {("line", "70000"), ("line", "10"), ("label", "Far"), ("name", "X")}


def test_formatting_settles():
    once = round_trip("dim shared t as integer\nfor i=1 to 10\nnext i", by_name=False)
    assert round_trip("\n".join(once), by_name=False) == once


def test_the_table_is_a_parameter(tmp_path):
    assert len(read_rows(DEFAULT)) == 390
    path = tmp_path / "t.md"
    path.write_text("| code | mnemonic | operands | arity | text | form |\n|---|---|---|---|---|---|\n| 0100 | PLUS | u16,ref | * | `+` | infix |\n| 0200P | NEW |  | 1 | `NEW` | stmt |\n")
    (a, b) = read_rows(str(path))
    assert (a.code, a.operands, a.arity, a.later, b.arity, b.later) == (256, ("u16", "ref"), None, False, 1, True)
    (tmp_path / "none.md").write_text("x")
    with pytest.raises(ValueError, match="no opcode table"):
        read_rows(str(tmp_path / "none.md"))
