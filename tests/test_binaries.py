"""Headers of crafted files, reports and declared modules."""

import struct

import pytest
from pyspark.sql import functions as F

from rulespark.functions import binaries
from rulespark.operators.scan import evaluate
from rulespark.plans.lexer import RuleError


def pe_file(machine=0x8664, magic=0x20B, sections=((b".text", 0x1000, 0x400), (b".data", 0x2000, 0x600)), dll=True, clr=0):
    optional = bytearray(240)
    struct.pack_into("<HBB", optional, 0, magic, 14, 2)
    struct.pack_into("<I", optional, 16, 0x1234)
    struct.pack_into("<H", optional, 68, 3)
    struct.pack_into("<I", optional, (112 if magic == 0x20B else 96) + 14 * 8, clr)
    head = struct.pack("<IHHIIIHH", 0x4550, machine, len(sections), 77, 0, 0, len(optional), 0x22 | (0x2000 if dll else 0))
    table = b"".join(name.ljust(8, b"\0") + struct.pack("<IIIIIIHHI", 0x300, va, 0x200, raw, 0, 0, 0, 0, 0x60000020) for name, va, raw in sections)
    return b"MZ" + b"\0" * 58 + struct.pack("<I", 0x80) + b"\0" * 64 + head + bytes(optional) + table + b"\0" * 64


def elf_file(wide=True, big=False):
    order = ">" if big else "<"
    ident = b"\x7fELF" + bytes([2 if wide else 1, 2 if big else 1, 1]) + b"\0" * 9
    if wide:
        head = struct.pack(order + "HHIQQQIHHHHHH", 2, 62, 1, 0x401000, 64, 120, 0, 64, 56, 1, 64, 1, 0)
        segment = struct.pack(order + "IIQQQQQQ", 1, 5, 0, 0x400000, 0x400000, 500, 600, 4096)
        section = struct.pack(order + "IIQQQQIIQQ", 0, 1, 6, 0x401000, 0x80, 32, 0, 0, 16, 0)
    else:
        head = struct.pack(order + "HHIIIIIHHHHHH", 2, 3, 1, 0x8048000, 52, 84, 0, 52, 32, 1, 40, 1, 0)
        segment = struct.pack(order + "IIIIIIII", 1, 0, 0x8048000, 0x8048000, 500, 600, 5, 4096)
        section = struct.pack(order + "IIIIIIIIII", 0, 1, 6, 0x8048000, 0x80, 32, 0, 0, 16, 0)
    return ident + head + segment + section


def hits(spark, condition, blobs, imports='import "pe" import "elf"', externals=None):
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(blobs)], "id int, data binary")
    return {r["id"] for r in evaluate(df, f"{imports} rule r {{ condition: {condition} }}", externals=externals).filter("r").collect()}


def test_pe(spark):
    blobs = [pe_file(), pe_file(0x14C, 0x10B, dll=False), b"MZ not one", b"", pe_file(clr=0x2000)]
    assert hits(spark, "pe.is_pe == 1", blobs) == {0, 1, 4}
    assert hits(spark, "pe.machine == pe.MACHINE_AMD64 and pe.is_64bit() == 1 and pe.is_dll() == 1 and pe.number_of_sections == 2 and pe.timestamp == 77 and pe.subsystem == pe.SUBSYSTEM_WINDOWS_CUI", blobs) == {0, 4}
    assert hits(spark, "pe.is_32bit() == 1 and not pe.is_dll() == 1 and pe.linker_version.major == 14", blobs) == {1}
    assert hits(spark, 'pe.sections[1].name == ".data" and pe.sections[0].virtual_address == 0x1000 and for any s in pe.sections : (s.raw_data_offset == 0x600)', blobs) == {0, 1, 4}
    assert hits(spark, 'pe.section_index(".data") == 1 and pe.section_index(0x410) == 0 and pe.rva_to_offset(0x2010) == 0x610', blobs) == {0, 1, 4}
    assert hits(spark, "dotnet.is_dotnet == 1", blobs, 'import "dotnet"') == {4}


def test_elf(spark):
    blobs = [elf_file(), elf_file(False), elf_file(True, True), b"\x7fELF", b"x"]
    assert hits(spark, "elf.type == elf.ET_EXEC", blobs) == {0, 1, 2}
    assert hits(spark, "elf.machine == elf.EM_X86_64 and elf.entry_point == 0x401000 and elf.sections[0].size == 32 and elf.segments[0].memory_size == 600 and elf.segments[0].flags & elf.PF_X == 1", blobs) == {0, 2}
    assert hits(spark, "elf.machine == elf.EM_386 and elf.number_of_sections == 1 and elf.sections[0].offset == 0x80 and elf.segments[0].file_size == 500", blobs) == {1}


def test_bound_modules(spark):
    report = '{"network":{"http":[{"uri":"http://bad.example/x","user-agent":"curl"}],"domains":[{"domain":"a.example"}]},"behavior":{"summary":{"mutexes":["Global_1"]}}}'
    bound = {
        "cuckoo": F.lit(report), "vt": F.struct(F.struct(F.lit(7).cast("long").alias("malicious")).alias("stats")),
        "pe": F.struct(F.array(F.struct(F.lit("KERNEL32.dll").alias("library"), F.array(F.lit("LoadLibraryA")).alias("functions"))).alias("imports"), F.array(F.lit("run")).alias("exports")),
    }
    every = 'import "cuckoo" import "vt" import "pe"'
    for condition, want in [
        ("cuckoo.network.http_request(/bad\\.example/) == 1 and cuckoo.network.http_user_agent(/^curl/) == 1", True), ("cuckoo.network.dns_lookup(/^b/) == 1", False), ("cuckoo.sync.mutex(/Global/) == 1 and cuckoo.network.tcp(/x/) == 0", True),
        ("vt.stats.malicious > 5", True), ('pe.imports("kernel32.dll") == 1 and pe.imports("kernel32.dll", "loadlibrarya") == 1 and pe.imports("user32.dll") == 0', True), ('pe.exports("run") == 1 and pe.exports_index("run") == 0', True),
    ]:
        assert hits(spark, condition, [b"x"], every, bound) == ({0} if want else set()), condition


def test_declared_modules(spark):
    spec = '{"name": "acme", "attributes": {"score": "integer"}, "functions": {"above": {"return": "boolean", "parameters": ["integer"], "min_parameters": 1}}}'
    binaries.register(spec, {"acme.above": lambda m, a: m["score"] > a[0][0]})
    bound = {"acme": F.struct(F.col("id").cast("long").alias("score"))}
    assert hits(spark, "acme.above(0) and acme.score < 3", [b"a", b"b", b"c", b"d"], 'import "acme"', bound) == {1, 2}
    with pytest.raises(RuleError):
        hits(spark, "acme.above(0, 1)", [b"a"], 'import "acme"', bound)
    with pytest.raises(RuleError):
        hits(spark, "pe.imphash(1) == other.x", [b"a"])
    for bad in ({}, {"name": "x", "functions": {"f": 1}}, {"name": "x", "functions": {"f": {"parameters": [], "min_parameters": 2}}}):
        with pytest.raises(RuleError):
            binaries.declared(bad)


def test_external_rules(spark):
    df = spark.createDataFrame([(1, bytearray(b"a"), True), (2, bytearray(b"a"), False)], "id int, data binary, seen boolean")
    out = evaluate(df, 'rule r { strings: $a = "a" condition: $a and other_rule }', externals={"other_rule": F.col("seen")})
    assert {r["id"] for r in out.filter("r").collect()} == {1}
