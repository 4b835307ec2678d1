"""Reports over decoded words, and what a modern compiler takes otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words
from ..sources.opcodes import DEFAULT, opcode_table, read_rows
from .render import CALLS, render_lines

# Severities, gravest first; findings by mnemonic, with the word that is shown; routines that are called by name; devices.
SEVERITIES = ("blocked", "ignored", "rework", "platform")
RULES = {
    "ignored": {
        "CALLS": "CALLS", "IOCTL": "IOCTL", "IOCTL$": "IOCTL$", "ERDEV": "ERDEV", "ERDEV$": "ERDEV$", "FILEATTR": "FILEATTR", "FRE": "FRE", "SETMEM": "SETMEM", "SIGNAL_EVENT": "SIGNAL", "TRON": "TRON", "TROFF": "TROFF",
        "DATE$_SET": "DATE$ =", "TIME$_SET": "TIME$ =", "PEN_EVENT": "PEN", "PEN_FUNC": "PEN", "PLAY_EVENT_N": "PLAY(n)", "UEVENT": "UEVENT", "WIDTH_LPRINT": "WIDTH LPRINT",
    },
    "rework": {"DEF_FN": "DEF FN", "END_DEF": "END DEF"},
    "platform": {"CHAIN": "CHAIN", "RUN_FILE": "RUN <file>", "LPRINT": "LPRINT", "LOCK": "LOCK", "UNLOCK": "UNLOCK"},
}
LATER_SHOWN = {"ISAM_MOVE": "MOVEFIRST / MOVELAST / MOVENEXT / MOVEPREVIOUS", "ISAM_SEEK": "SEEKEQ / SEEKGE / SEEKGT", "OPEN_ISAM": "OPEN ... FOR ISAM"}
LIBRARY_ROUTINES = ("ABSOLUTE", "INTERRUPT", "INTERRUPTX")
DEVICES = {"LPT1": "LPT1", "LPT2": "LPT2", "LPT3": "LPT3", "CON": "CON", "KYBD": "KYBD", "SCRN": "SCRN", "COM1": "COM", "COM2": "COM"}
OPENS = ("OPEN", "OPEN_RANDOM", "OPEN_MODE_STRING")
LATER_PRODUCT = "BASIC 7 PDS"
#: What to do about a finding, by severity.
ADVICE = {
    "blocked": "not supported: needs another way to do it",
    "ignored": "compiles, but has no effect: check what the program expects of it",
    "rework": "has to be written another way before it compiles",
    "platform": "works on one platform only",
}

RULE = "mnemonic string, severity string, keyword string, advice string, later boolean"
FOUND = ("path", "section", "section_name", "shown_no", "instr_no", "text", "keyword", "severity", "advice")


def classified(rows: DataFrame, opcodes: DataFrame) -> DataFrame:
    """rows with mnemonic (null if unidentified), operands and class: header, opcode or unidentified. Words of the base product."""
    known = opcodes.where("not later").select("code", "mnemonic", "operands")
    found = rows.join(F.broadcast(known), F.col("word") == F.col("code"), "left").drop("code")
    found = found.withColumn("mnemonic", F.coalesce("mnemonic", words.family_mnemonic(F.col("word"))))
    found = found.withColumn("operands", F.coalesce("operands", words.family_operands(F.col("word"))))
    kind = F.when(words.is_line_header(F.col("word")), "header").when(F.col("mnemonic").isNotNull(), "opcode").otherwise("unidentified")
    return found.withColumn("class", kind)


def stats(found: DataFrame, file: str, section: str) -> DataFrame:
    """Opcodes and unidentified words by section, by file and in total, and the share identified (all of none)."""
    ops = found.where("class <> 'header'").rollup(file, section).agg(F.count(F.lit(1)).alias("opcodes"), F.count_if(F.col("class") == "unidentified").alias("unidentified"))
    share = F.when(F.col("opcodes") == 0, 100.0).otherwise(F.round(100.0 * (F.col("opcodes") - F.col("unidentified")) / F.col("opcodes"), 4))
    return ops.select(F.coalesce(file, F.lit("TOTAL")).alias("file"), F.coalesce(section, F.lit("TOTAL")).alias("section"), "opcodes", "unidentified", share.alias("percent"))


def lint(found: DataFrame, rules: DataFrame) -> DataFrame:
    """found: file, line, pos, mnemonic. One finding a line and mnemonic, the first; rules are broadcast."""
    hit = found.join(F.broadcast(rules.where("not later").select("mnemonic", "severity")), "mnemonic")
    return hit.groupBy("file", "line", "mnemonic", "severity").agg(F.min("pos").alias("pos"))


def rule_table(spark: SparkSession, opcodes: str = DEFAULT) -> DataFrame:
    """mnemonic, severity, keyword, advice and later: a rule for every word that only the later product has, too."""
    rows = [(m, severity, shown, ADVICE[severity], False) for severity, found in RULES.items() for m, shown in found.items()]
    rows += [(op.mnemonic, "blocked", LATER_SHOWN.get(op.mnemonic) or op.text or op.mnemonic, ADVICE["blocked"], True) for op in read_rows(opcodes) if op.later]
    return spark.createDataFrame(rows, RULE)


def device_of(text: Column) -> Column:
    """First device that a quoted name begins with, colon included; both serial ports are COM."""
    up = F.upper(text)
    out = F.lit(None).cast("string")
    for device, shown in reversed(DEVICES.items()):
        out = F.when(F.contains(up, F.lit(f'"{device}:')), shown).otherwise(out)
    return out


def lint_check(files: DataFrame, opcodes: str = DEFAULT) -> DataFrame:
    """files: path, content. Findings (see ``FOUND``) of whole files, with the line as it is written and its number among those.

    A mnemonic or a routine counts once a line, at its first instruction; an OPEN
    of a device counts at each. A file of the later product has one finding as such.
    """
    spark = files.sparkSession
    later = files.select("path", (F.hex(F.substring("content", 2, 1)) == "02").alias("is_later"))
    lines = render_lines(files.select("path", "content"), opcodes).where("instrs is not null")
    instrs = lines.join(later, "path").select("path", "is_later", "section", "section_name", "shown_no", F.trim("text").alias("text"), F.inline("instrs"))
    by_rule = instrs.join(F.broadcast(rule_table(spark, opcodes)), "mnemonic").where("is_later or not later")
    routine = F.upper("name")
    by_name = instrs.where(F.col("mnemonic").isin(*CALLS) & routine.isin(*LIBRARY_ROUTINES)).withColumns(
        {"severity": F.lit("rework"), "keyword": F.concat(F.lit("CALL "), "name"), "advice": F.lit(ADVICE["rework"]), "mnemonic": routine}
    )
    once = by_rule.select(*FOUND, "mnemonic").unionByName(by_name.select(*FOUND, "mnemonic"))
    first = F.min(F.struct("instr_no", "keyword")).alias("f")
    once = once.groupBy("path", "section", "section_name", "shown_no", "text", "mnemonic", "severity", "advice").agg(first).withColumns({"instr_no": F.col("f.instr_no"), "keyword": F.col("f.keyword")})
    device = device_of(F.col("text"))
    opened = instrs.where(F.col("mnemonic").isin(*OPENS) & device.isNotNull()).withColumns({"severity": F.lit("ignored"), "keyword": F.concat(F.lit("OPEN "), device, F.lit(":")), "advice": F.lit(ADVICE["ignored"])})
    whole = later.where("is_later").select(
        "path", F.lit(0).alias("section"), F.lit(None).cast("string").alias("section_name"), F.lit(1).alias("shown_no"), F.lit(-1).alias("instr_no"), F.lit(f"saved by {LATER_PRODUCT}").alias("text"),
        F.lit(LATER_PRODUCT).alias("keyword"), F.lit("blocked").alias("severity"), F.lit(ADVICE["blocked"]).alias("advice"),
    )
    return once.select(*FOUND).unionByName(opened.select(*FOUND)).unionByName(whole)


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with rank, gravest first, then by file, section (the module first) and line."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) - 1
    return findings.withColumn("rank", rank.cast("int")).orderBy("rank", "path", F.coalesce("section_name", F.lit("")), "shown_no", "instr_no", "keyword")


def lint_report(findings: DataFrame) -> DataFrame:
    """Findings by severity, gravest first, with the severities that have none."""
    spark = findings.sparkSession
    ranks = spark.createDataFrame([(i, s) for i, s in enumerate(SEVERITIES)], "rank int, severity string")
    counted = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return ranks.join(counted, "severity", "left").select("rank", "severity", F.coalesce("n", F.lit(0)).alias("n")).orderBy("rank")


__all__ = ["classified", "device_of", "lint", "lint_check", "lint_report", "opcode_table", "ranked", "rule_table", "stats"]
