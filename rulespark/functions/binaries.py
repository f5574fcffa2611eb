"""Modules of file formats as struct columns, read from the bytes in JVM expressions, and modules that users declare.

`pe` and `elf` give header fields, sections and segments (imports, exports and resources need a parser: a table that
has them can bind its own struct under the module's name).  `dotnet` tells whether there is a CLR header.  `cuckoo` looks
into a JSON report, `vt` is a struct of file metadata; both are columns that the caller binds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions import modules as M
from rulespark.plans.lexer import RuleError

#: Machine types, characteristics and subsystems.  Fixed values.
PE_CONSTANTS = {
    "MACHINE_UNKNOWN": 0x0, "MACHINE_I386": 0x14C, "MACHINE_ARM": 0x1C0, "MACHINE_ARMNT": 0x1C4, "MACHINE_IA64": 0x200, "MACHINE_AMD64": 0x8664, "MACHINE_ARM64": 0xAA64,
    "RELOCS_STRIPPED": 0x1, "EXECUTABLE_IMAGE": 0x2, "LINE_NUMS_STRIPPED": 0x4, "LOCAL_SYMS_STRIPPED": 0x8, "LARGE_ADDRESS_AWARE": 0x20, "MACHINE_32BIT": 0x100, "DEBUG_STRIPPED": 0x200, "SYSTEM": 0x1000, "DLL": 0x2000,
    "SUBSYSTEM_UNKNOWN": 0, "SUBSYSTEM_NATIVE": 1, "SUBSYSTEM_WINDOWS_GUI": 2, "SUBSYSTEM_WINDOWS_CUI": 3, "SUBSYSTEM_POSIX_CUI": 7, "SUBSYSTEM_EFI_APPLICATION": 10,
    "SECTION_CNT_CODE": 0x20, "SECTION_CNT_INITIALIZED_DATA": 0x40, "SECTION_CNT_UNINITIALIZED_DATA": 0x80, "SECTION_MEM_EXECUTE": 0x20000000, "SECTION_MEM_READ": 0x40000000, "SECTION_MEM_WRITE": 0x80000000,
}
ELF_CONSTANTS = {
    "ET_NONE": 0, "ET_REL": 1, "ET_EXEC": 2, "ET_DYN": 3, "ET_CORE": 4, "EM_NONE": 0, "EM_386": 3, "EM_MIPS": 8, "EM_PPC": 20, "EM_ARM": 40, "EM_X86_64": 62, "EM_AARCH64": 183,
    "SHT_NULL": 0, "SHT_PROGBITS": 1, "SHT_SYMTAB": 2, "SHT_STRTAB": 3, "SHT_NOBITS": 8, "SHF_WRITE": 1, "SHF_ALLOC": 2, "SHF_EXECINSTR": 4, "PT_NULL": 0, "PT_LOAD": 1, "PT_DYNAMIC": 2, "PT_INTERP": 3, "PT_NOTE": 4, "PF_X": 1, "PF_W": 2, "PF_R": 4,
}


def reader(data: Column):
    return lambda offset, width, big=False: M.integer(data, offset if isinstance(offset, Column) else F.lit(offset), width, False, big)


def quad(u, offset: Column, big=False) -> Column:
    """A 64-bit number that fits a signed one."""
    low, high = (u(offset + 4, 4, big), u(offset, 4, big)) if big else (u(offset, 4, big), u(offset + 4, 4, big))
    return F.when(high < 1 << 31, low + high * (1 << 32))


def name_at(data: Column, offset: Column, size: int) -> Column:
    return F.split(F.decode(F.substring(data, (offset + 1).cast("int"), F.lit(size)), "ISO-8859-1"), "\\x00")[0]


def pe(data: Column) -> Column:
    """Header fields and sections; `is_pe` is 0 and the rest null for anything else."""
    u = reader(data)

    def header(at: Column) -> Column:
        optional, magic = at + 24, u(at + 24, 2)
        plus = magic == 0x20B
        n, table = u(at + 6, 2), optional + u(at + 20, 2)
        section = lambda k: M.let(table + k * 40, lambda s: F.struct(
            name_at(data, s, 8).alias("name"), u(s + 8, 4).alias("virtual_size"), u(s + 12, 4).alias("virtual_address"), u(s + 16, 4).alias("raw_data_size"), u(s + 20, 4).alias("raw_data_offset"), u(s + 36, 4).alias("characteristics")))
        directories = optional + F.when(plus, 112).otherwise(96)
        good = (u(0, 2) == 0x5A4D) & (u(at, 4) == 0x4550)
        whole = F.struct(
            F.lit(1).cast("long").alias("is_pe"), u(at + 4, 2).alias("machine"), n.alias("number_of_sections"), u(at + 8, 4).alias("timestamp"), u(at + 12, 4).alias("pointer_to_symbol_table"),
            u(at + 16, 4).alias("number_of_symbols"), u(at + 20, 2).alias("size_of_optional_header"), u(at + 22, 2).alias("characteristics"), magic.alias("opthdr_magic"),
            F.struct(u(optional + 2, 1).alias("major"), u(optional + 3, 1).alias("minor")).alias("linker_version"), u(optional + 4, 4).alias("size_of_code"), u(optional + 16, 4).alias("entry_point_raw"), u(optional + 20, 4).alias("base_of_code"),
            F.when(plus, quad(u, optional + 24)).otherwise(u(optional + 28, 4)).alias("image_base"), u(optional + 32, 4).alias("section_alignment"), u(optional + 36, 4).alias("file_alignment"),
            u(optional + 56, 4).alias("size_of_image"), u(optional + 60, 4).alias("size_of_headers"), u(optional + 64, 4).alias("checksum"), u(optional + 68, 2).alias("subsystem"), u(optional + 70, 2).alias("dll_characteristics"),
            u(optional + F.when(plus, 108).otherwise(92), 4).alias("number_of_rva_and_sizes"), u(directories + 14 * 8, 4).alias("clr_header"),
            F.transform(F.when(n.between(1, 96), F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), section).alias("sections"),
        )
        return F.when(good, whole)

    return M.let(u(0x3C, 4), header)


def elf(data: Column) -> Column:
    """Header fields, sections (without names) and segments."""
    u = reader(data)
    wide, big = u(4, 1) == 2, u(5, 1) == 2

    def two(offset32, offset64, width32, width64) -> Column:
        """A field by class and byte order."""
        at = lambda o: o if isinstance(o, Column) else F.lit(o)
        one = lambda o, w, b: quad(u, at(o), b) if w == 8 else u(at(o), w, b)
        pick = lambda b: F.when(wide, one(offset64, width64, b)).otherwise(one(offset32, width32, b))
        return F.when(big, pick(True)).otherwise(pick(False))

    same = lambda o, w: two(o, o, w, w)
    n_sections, n_segments = two(48, 60, 2, 2), two(44, 56, 2, 2)
    many = lambda n: F.when(n.between(1, 4096), F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    section = lambda k: M.let(two(32, 40, 4, 8) + k * two(46, 58, 2, 2), lambda s: F.struct(
        same(s + 4, 4).alias("type"), two(s + 8, s + 8, 4, 8).alias("flags"), two(s + 12, s + 16, 4, 8).alias("address"), two(s + 16, s + 24, 4, 8).alias("offset"), two(s + 20, s + 32, 4, 8).alias("size")))
    segment = lambda k: M.let(two(28, 32, 4, 8) + k * two(42, 54, 2, 2), lambda s: F.struct(
        same(s, 4).alias("type"), two(s + 24, s + 4, 4, 4).alias("flags"), two(s + 4, s + 8, 4, 8).alias("offset"), two(s + 8, s + 16, 4, 8).alias("virtual_address"), two(s + 16, s + 32, 4, 8).alias("file_size"), two(s + 20, s + 40, 4, 8).alias("memory_size")))
    whole = F.struct(
        same(16, 2).alias("type"), same(18, 2).alias("machine"), two(24, 24, 4, 8).alias("entry_point"), n_sections.alias("number_of_sections"), n_segments.alias("number_of_segments"),
        two(32, 40, 4, 8).alias("sh_offset"), two(46, 58, 2, 2).alias("sh_entry_size"), two(28, 32, 4, 8).alias("ph_offset"), two(42, 54, 2, 2).alias("ph_entry_size"),
        F.transform(many(n_sections), section).alias("sections"), F.transform(many(n_segments), segment).alias("segments"),
    )
    return F.when(u(0, 4) == 0x464C457F, whole)


def dotnet(data: Column) -> Column:
    return M.let(pe(data), lambda p: F.struct((F.coalesce(p["clr_header"], F.lit(0)) > 0).cast("long").alias("is_dotnet")))


#: Columns of modules that follow from the bytes alone.
FROM_BYTES = {"pe": pe, "elf": elf, "dotnet": dotnet}
CONSTANTS = {"pe": PE_CONSTANTS, "elf": ELF_CONSTANTS}


def _bits(p: Column, name: str, mask: int) -> Column:
    return (p[name].bitwiseAND(F.lit(mask)) != 0).cast("long")


def rva_to_offset(p: Column, rva: Column) -> Column:
    """By the section that holds the address; null if none does."""
    hit = F.filter(p["sections"], lambda s: (rva >= s["virtual_address"]) & (rva < s["virtual_address"] + F.greatest(s["virtual_size"], s["raw_data_size"])))
    return M.let(F.get(hit, F.lit(0)), lambda s: s["raw_data_offset"] + rva - s["virtual_address"])


def _section_index(p: Column, arguments) -> Column:
    what, kind = arguments[0][:2]
    at = lambda test: F.get(F.filter(F.transform(p["sections"], lambda s, k: F.when(test(s), k)), lambda k: k.isNotNull()), F.lit(0)).cast("long")
    if kind == "string":
        return at(lambda s: s["name"] == what)
    return at(lambda s: (what >= s["raw_data_offset"]) & (what < s["raw_data_offset"] + s["raw_data_size"]))


def _named(p: Column, arguments) -> Column:
    """imports(dll[, function]) over the struct's `imports`, an array of (library, functions)."""
    same = lambda a, b: F.lower(a) == F.lower(b)
    test = lambda x: same(x["library"], arguments[0][0])
    both = lambda x: test(x) & F.exists(x["functions"], lambda f: same(f, arguments[1][0]))
    return F.exists(p["imports"], test if len(arguments) == 1 else both).cast("long")


def _report(path: str, fields: tuple[str, ...]):
    """A test whether any entry under a path of the JSON report has a field that the pattern finds."""

    def test(report: Column, arguments) -> Column:
        pattern = arguments[0][2] if len(arguments[0]) > 2 else arguments[0][0]
        entries = F.from_json(F.get_json_object(report, f"$.{path}"), "array<string>")
        hit = lambda e: F.coalesce(*[F.get_json_object(e, f"$.{f}") for f in fields], e).rlike(pattern)
        return F.exists(F.coalesce(entries, F.array().cast("array<string>")), hit).cast("long")

    return test


#: function -> (builder over the module's column and the arguments, kind)
FUNCTIONS = {
    "pe.is_dll": (lambda p, a: _bits(p, "characteristics", 0x2000), "int"),
    "pe.is_32bit": (lambda p, a: (p["opthdr_magic"] == 0x10B).cast("long"), "int"),
    "pe.is_64bit": (lambda p, a: (p["opthdr_magic"] == 0x20B).cast("long"), "int"),
    "pe.rva_to_offset": (lambda p, a: rva_to_offset(p, a[0][0]), "int"),
    "pe.section_index": (_section_index, "int"),
    "pe.imports": (_named, "int"),
    "pe.exports": (lambda p, a: F.array_contains(p["exports"], a[0][0]).cast("long"), "int"),
    "pe.exports_index": (lambda p, a: F.nullif(F.array_position(p["exports"], a[0][0]), F.lit(0)) - 1, "int"),
    "pe.language": (lambda p, a: F.exists(p["resources"], lambda r: r["language"].bitwiseAND(F.lit(0xFF)) == a[0][0]).cast("long"), "int"),
    "pe.locale": (lambda p, a: F.exists(p["resources"], lambda r: r["language"] == a[0][0]).cast("long"), "int"),
    "pe.imphash": (lambda p, a: p["imphash"], "string"),
    "pe.calculate_checksum": (lambda p, a: p["calculated_checksum"], "int"),
    "elf.import_md5": (lambda p, a: p["import_md5"], "string"),
    "elf.telfhash": (lambda p, a: p["telfhash"], "string"),
    "cuckoo.network.http_request": (_report("network.http", ("uri",)), "int"),
    "cuckoo.network.http_get": (_report("network.http_get", ("uri",)), "int"),
    "cuckoo.network.http_post": (_report("network.http_post", ("uri",)), "int"),
    "cuckoo.network.http_user_agent": (_report("network.http", ("user-agent",)), "int"),
    "cuckoo.network.dns_lookup": (_report("network.domains", ("domain",)), "int"),
    "cuckoo.network.host": (_report("network.hosts", ("ip",)), "int"),
    "cuckoo.network.tcp": (_report("network.tcp", ("dst",)), "int"),
    "cuckoo.network.udp": (_report("network.udp", ("dst",)), "int"),
    "cuckoo.registry.key_access": (_report("behavior.summary.keys", ()), "int"),
    "cuckoo.filesystem.file_access": (_report("behavior.summary.files", ()), "int"),
    "cuckoo.sync.mutex": (_report("behavior.summary.mutexes", ()), "int"),
}

KINDS = {"integer": "int", "int": "int", "i": "int", "float": "float", "double": "float", "string": "string", "s": "string", "boolean": "bool", "bool": "bool", "any": "unknown"}


@dataclass
class Module:
    """A declared module: kinds of its attributes and constants, and its functions' kinds and arities."""

    name: str
    attributes: dict = field(default_factory=dict)
    functions: dict = field(default_factory=dict)  # name -> (kind, least, most or None)
    constants: dict = field(default_factory=dict)


def declared(spec: str | dict | list) -> list[Module]:
    """Modules from JSON: {"name", "attributes": {a: type}, "functions": {f: {"return", "parameters", "min_parameters", "variadic"}}, "constants"}."""
    data = json.loads(spec) if isinstance(spec, str) else spec
    out = []
    for one in data if isinstance(data, list) else [data]:
        if not isinstance(one, dict) or not isinstance(one.get("name"), str) or not one["name"].isidentifier():
            raise RuleError("a module needs a name")
        functions = {}
        for f, how in one.get("functions", {}).items():
            if not isinstance(how, dict):
                raise RuleError(f"function {f} of module {one['name']} must be an object")
            n = len(how.get("parameters", []))
            least = how.get("min_parameters", n)
            if not 0 <= least <= n:
                raise RuleError(f"function {f} of module {one['name']}: min_parameters is not between 0 and {n}")
            functions[f] = (KINDS.get(how.get("return", "any"), "unknown"), least, None if how.get("variadic") else n)
        kinds = lambda d: {k: KINDS.get(v, "unknown") if isinstance(v, str) else "unknown" for k, v in d.items()}
        out.append(Module(one["name"], kinds(one.get("attributes", {})), functions, kinds(one.get("constants", {}))))
    return out


#: Declared modules by name, and builders of their functions.
DECLARED: dict[str, Module] = {}


def register(spec: str | dict | list, functions: dict | None = None) -> None:
    """Declare modules; `functions` maps "module.function" to builders (module's column, [(Column, kind, ...)]) -> Column."""
    for m in declared(spec):
        DECLARED[m.name] = m
        for f, (kind, _, _) in m.functions.items():
            if functions and f"{m.name}.{f}" in functions:
                FUNCTIONS[f"{m.name}.{f}"] = (functions[f"{m.name}.{f}"], kind)
