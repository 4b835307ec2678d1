"""Files built by hand from the format: tables, lines, help databases, and what doesn't fit."""

import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.operators import decode, render, structure
from lodestack.sources import batches, helpfile, opcodes

OPS = opcodes.Table([opcodes.Op(10, "TEXT_LINE", ("str",), 0, "", "stmt"), opcodes.Op(0x0200, "WIDE", ("u32", "ref"), None, "", "stmt"), opcodes.Op(0x0202, "FAR", ("f64",), None, "", "stmt", True)])
TRAILER = struct.pack("<8H", 65535, 65535, 65535, 65535, 2, 0, 0, 0x0102)


def entry(flags, payload):
    return struct.pack("<HBB", 0, flags, len(payload)) + payload


def image(names, module, procs=(), version=0, flags=0):
    shift = {0: 0, 2: 1}[version]
    table = b"".join(names)
    head = bytearray(114 + shift)
    head[0], head[1], head[19] = 0xFC, version, flags
    end = 114 + shift + len(table)
    struct.pack_into("<H", head, 26 + shift, end - 28 - shift)
    struct.pack_into("<H", head, 110 + shift, end - 28 - shift)
    struct.pack_into("<H", head, 28 + shift + 2 * 5, 86)
    made = bytes(head) + table + struct.pack("<H", len(module)) + module + TRAILER
    for name, body in procs:
        made += bytes([0, len(name), 0]) + name + struct.pack("<BBBH", 1, 0, 7, len(body)) + body + TRAILER
    return made


def words(*w):
    return struct.pack(f"<{len(w)}H", *w)


MODULE = words(0x0800, 0x040B, 86) + words(0x0005, 7, 92, 33, 0x0964, 0x000A, 3) + b"abc\0" + words(9, 8)
GOOD = image([entry(0, b"count"), entry(6, words(1200)), entry(0x40, b"Go\xe9")], MODULE, [(b"Go", words(0x0200, 9, 1, 86))], flags=0x80)
BAD = {
    "empty": (b"", "empty file"), "magic": (b"\xfb\0", "wrong magic"), "version": (b"\xfc\1", "unknown version"), "short": (b"\xfc\0\0", "truncated header"),
    "name": (image([entry(0, b"a")[:-1]], b""), "name entry past the table"), "section": (GOOD[:-1], "section past the file"),
}


MANY = 1_000
READERS = {
    "parse_names": lambda f: structure.parse_names(f), "parse_sections": lambda f: structure.parse_sections(f), "decode_sections": lambda f: decode.decode_sections(structure.parse_sections(f)),
    "render_lines": lambda f: render.render_lines(f), "render_files": lambda f: render.render_files(f),
}


@pytest.mark.parametrize("reader", READERS)
def test_a_batch_of_files_is_never_objects_at_once(spark, monkeypatch, reader):
    made, real = [], F.pandas_udf
    monkeypatch.setattr(F, "pandas_udf", lambda *a: (lambda f: (made.append(f), real(*a)(f))[1]) if len(a) == 1 else (made.append(a[0]), real(*a))[1])
    READERS[reader](spark.createDataFrame([("a", GOOD)], "path string, content binary"))
    content = pd.Series([MODULE + bytes(2_000) if reader == "decode_sections" else GOOD + bytes(2_000)] * MANY)
    found = list(made[-1](iter([(content, pd.Series([0] * MANY)) if reader == "decode_sections" else content])))
    assert sum(map(len, found)) == MANY and max(map(len, found)) < MANY / 5


def test_slices_keep_rows_and_order():
    rows = [b"x" * n for n in (0, 10, 3_000, 5, 40, 50)] + [None]
    cut = list(batches.slices([pd.Series(rows), pd.Series([], dtype=object)], limit=50))
    assert [list(c) for c in cut] == [rows[:2], rows[2:3], rows[3:5], rows[5:6], rows[6:], []]
    pairs = list(batches.slices([(pd.Series(["ab", "c"]), pd.Series([["de"], None]))], limit=4))
    assert [[list(c) for c in p] for p in pairs] == [[["ab"], [["de"]]], [["c"], [None]]]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("good", GOOD)] + [(k, v[0]) for k, v in BAD.items()], "path string, content binary")


def test_header_and_buckets(files):
    found = {r.path: r for r in structure.header(files).collect()}
    assert found["good"].error is None and found["good"].uses_tabs and found["good"].shift == 0
    assert {k: found[k].error for k in ("empty", "magic", "version", "short")} == {k: BAD[k][1] for k in ("empty", "magic", "version", "short")}
    heads = {r.bucket: r["head"] for r in structure.buckets(files.where("path = 'good'")).collect()}
    assert len(heads) == 41 and heads[5] == 86 and heads[6] == 0


def test_names(files):
    rows = structure.parse_names(files).collect()
    assert [(r.ref, r.flags, r.name) for r in rows if r.path == "good"] == [(86, 0, "count"), (95, 6, "1200"), (101, 64, "Goé")]
    assert {r.path: r.error for r in rows if r.error} == {k: v[1] for k, v in BAD.items() if k != "section"}


def test_sections(files):
    rows = structure.parse_sections(files).collect()
    good = [r for r in rows if r.path == "good"]
    assert [(r.section, r.name, r.kind_byte, bytes(r.body)) for r in good] == [(0, None, None, MODULE), (1, "Go", 7, words(0x0200, 9, 1, 86))]
    assert good[0].trailer.line_count == 2 and good[0].trailer.kind == 0x0102
    assert {r.path: r.error for r in rows if r.error}["section"] == "section past the file"


def test_lines(spark, files):
    found = decode.decode_sections(structure.parse_sections(files.where("path = 'good'")))
    state = {r.section: (r.truncated, r.in_sync) for r in found.select("section", "truncated", "in_sync").collect()}
    assert state[0] == (False, True)
    lines = decode.line_rows(found.where("section = 0")).orderBy("line_no").collect()
    assert [(x.header, x.indent, x.label_ref) for x in lines] == [(0x0800, 2, None), (5, 33, 92)]
    instrs = decode.instr_rows(found.where("section = 0")).orderBy("line_no", "instr_no").collect()
    assert [(i.mnemonic, i.operands, i.payload and bytes(i.payload)) for i in instrs] == [("LOAD%", [86], None), ("PUSH_2", [], None), ("TEXT_LINE", [], b"abc")]


def test_streams_that_stop_short():
    ops = OPS
    lines, short = decode.decode(words(0, 0x0200, 1), ops)
    assert short and lines[0]["instrs"][0]["operands"] == []
    lines, short = decode.decode(words(4, 1), ops)
    assert short and len(lines) == 1
    lines, short = decode.decode(words(0, 10, 9) + b"ab", ops)
    assert not short and lines[0]["instrs"][0]["payload"] == b"ab"
    assert decode.decode(b"", ops) == ([], False)
    assert decode.decode(words(0, 0x0FFF, 9, 8), ops)[0][0]["instrs"][0]["mnemonic"] is None


def test_included_lines():
    lines, short = decode.decode(words(2, 1, 0x34, 5, 86, 0x0164, 2, 1, 0x0164, 3, 1, 40, 0x0164, 9, 8), OPS)
    assert not short and [(x["header"], x["included"], x["include_ref"], x["label_ref"], x["indent"]) for x in lines] == [(0x34, True, None, 86, 0), (2, True, 1, None, 0), (3, True, 1, None, 40)]


def test_later_product_differs():
    shown = lambda op: op and (op.mnemonic, op.operands)
    assert shown(OPS.of(0x140B)) == ("LOAD$", ("ref",)) and shown(OPS.of(0x140B, True)) == ("LOAD@", ("ref",))
    assert OPS.of(0x0065) is None and shown(OPS.of(0x0165)) == ("PUSH_INT", ("u16",)) and OPS.of(0x0202) is None and shown(OPS.of(0x0202, True)) == ("FAR", ("f64",))


def test_runs():
    m = decode.RUN_MARK
    assert decode.expand_runs(bytes([65, m, 4, 32, 66])) == b"A    B"
    assert decode.expand_runs(bytes([65, m, 4])) == bytes([65, m, 4])
    assert decode.expand_runs(b"") == b"" and decode.expand_runs(None) is None


def help_image(topics, contexts=(), keywords=(b"ALPHA", b"BETA")):
    """A tree of eight levels would take 511 words: word 0 is a comb, each 1 bit reaching a leaf or going on."""
    used = sorted({b for t in topics for b in t})
    tree, code = [0] * 512, {}
    for i, b in enumerate(used):  # at word 2i: 1 -> leaf at 2i + 1, 0 -> word 2i + 2
        tree[2 * i], tree[2 * i + 1], code[b] = 2 * (2 * i + 2), 0x8000 | b, "0" * i + "1"
    packed = []
    for t in topics:
        bits = "".join(code[b] for b in t)
        bits += "0" * (-len(bits) % 8)
        packed.append(struct.pack("<H", len(t)) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
    names = b"".join(n + b"\0" for n, _ in contexts)
    refs = b"".join(struct.pack("<H", t) for _, t in contexts)
    kw = b"".join(bytes([len(k)]) + k for k in keywords)
    index_at = 0x3A
    names_at = index_at + 4 * (len(topics) + 1)
    map_at, words_at = names_at + len(names), names_at + len(names) + len(refs)
    tree_at = words_at + len(kw)
    at, index = tree_at + 1024, []
    for p in packed:
        index.append(at)
        at += len(p)
    head = bytearray(index_at)
    head[:2], head[0x10:0x16] = b"LN", b"t.hlp\0"
    struct.pack_into("<2H", head, 8, len(topics), len(contexts))
    struct.pack_into("<6I", head, 0x22, index_at, names_at, map_at, words_at, tree_at, tree_at + 1024)
    return bytes(head) + struct.pack(f"<{len(topics) + 1}I", *index, at) + names + refs + kw + struct.pack("<512H", *tree) + b"".join(packed)


def test_help(spark):
    first = b"\x02\0\x06Hello\x02\0\x1a\x03\x10\0\x18\x02\x14\x01z\x02\x01junk\x04\0\x05\xffa.b\0!"
    data = help_image([first, b"", b"\x02\0\x03Hi!"], [(b"Print", 0), (b"PRINT", 2), (b"a b", 2)])
    files = spark.createDataFrame([("a", data), ("b", b"XX"), ("c", data[:200]), ("d", b"")], "path string, content binary")
    helps = helpfile.parse_hlp(files).cache()
    assert {r.path: r.error for r in helps.collect()} == {"a": None, "b": "not a help file", "c": "truncated", "d": "not a help file"}
    lines = [(r.topic, r.line) for r in helpfile.hlp_lines(helps).orderBy("topic", "line_no").collect()]
    assert lines == [(0, "Hello"), (0, "ALPHA  BETA z!"), (2, "Hi!")]
    wanted = spark.createDataFrame([("a", "PRINT"), ("a", "Print"), ("a", "print"), ("a", "none")], "path string, asked string")
    assert {r.asked: r.topic for r in helpfile.hlp_topic_for(helpfile.hlp_contexts(helps), wanted).collect()} == {"PRINT": 2, "Print": 0, "print": 0, "none": None}
    dump = {r.file: r.text for r in helpfile.hlp_dump(helps).collect()}
    assert dump == {"0000_Print.txt": "Hello\nALPHA  BETA z!\n", "0001_topic.txt": "\n", "0002_PRINT.txt": "Hi!\n"}
    assert helpfile.hlp_lines(helps, body=True).count() == 1


def test_declared_length(spark):
    df = spark.createDataFrame([(31,), (32,), (40,)], "b int").select(helpfile.declared_length(F.col("b")).alias("n"))
    assert [r.n for r in df.collect()] == [None, 31, 39]
