"""Small sources in many languages, made for each document, with what scanning them must find.

A document's file is ``id % 5`` blank lines and one of its language's variants, with the
id in its names. ``{n}`` stands for the id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Variant:
    text: str
    #: (kind, symbol, start line, end line), blank lines not counted.
    symbols: tuple[tuple[str, str, int, int], ...]
    #: (line, imported path, type)
    imports: tuple[tuple[int, str, str], ...] = ()


@dataclass(frozen=True)
class Sample:
    ending: str
    variants: tuple[Variant, ...]


SAMPLES = {
    "Rust": Sample("rs", (
        Variant(
            "use std::fmt;\nuse crate::shape{n}::Area;\n\npub struct Box{n} {\n    side: u32,\n}\n\nimpl Box{n} {\n    pub fn area(&self) -> u32 {\n        // fn ignored() {}\n        self.side\n    }\n}\n",
            (("Struct", "Box{n}", 4, 6), ("Function", "area", 9, 12), ("Method", "area", 9, 12)),
            ((1, "std::fmt", "stdlib"), (2, "crate::shape{n}::Area", "internal")),
        ),
        Variant(
            "mod part{n};\npub enum Kind{n} { A, B }\ntrait Named { fn name(&self) -> String; }\nconst LIMIT: usize = 3;\nmacro_rules! pick {\n    () => {};\n}\n",
            (("Enum", "Kind{n}", 2, 2), ("Trait", "Named", 3, 3), ("Function", "name", 3, 3), ("Constant", "LIMIT", 4, 4), ("Macro", "pick", 5, 7), ("Module", "part{n}", 1, 1)),
            ((1, "part{n}", "internal"),),
        ),
    )),
    "TypeScript": Sample("ts", (
        Variant(
            "import { a } from './lib{n}';\nimport fs from 'fs';\n\nexport interface Shape{n} {\n  side: number;\n}\nexport class Box{n} {\n  area(): number {\n    return 1;\n  }\n}\n",
            (("Interface", "Shape{n}", 4, 6), ("Class", "Box{n}", 7, 11), ("Method", "area", 8, 10)),
            ((1, "./lib{n}", "internal"), (2, "fs", "stdlib")),
        ),
        Variant(
            "import x from 'left-pad';\nexport enum Kind { A, B }\nexport type Pair{n} = [number, number];\nexport function sum{n}(a: number): number {\n  return a;\n}\nconst twice = (v: number) => v;\n",
            (("Enum", "Kind", 2, 2), ("Type", "Pair{n}", 3, 3), ("Function", "sum{n}", 4, 6), ("Function", "twice", 7, 7)),
            ((1, "left-pad", "external"),),
        ),
    )),
    "Go": Sample("go", (
        Variant(
            'package p\n\nimport (\n\t"fmt"\n\t"github.com/x/y{n}"\n)\n\ntype Box{n} struct {\n\tside int\n}\n\nfunc (b Box{n}) Area() int {\n\treturn b.side\n}\n',
            (("Struct", "Box{n}", 8, 10), ("Method", "Area", 12, 14)),
            ((4, "fmt", "stdlib"), (5, "github.com/x/y{n}", "external")),
        ),
        Variant(
            'package p\n\nimport "os"\n\ntype Named{n} interface {\n\tName() string\n}\n\nfunc Run{n}() {\n\tos.Exit(0)\n}\n\nconst Limit = 3\n',
            (("Interface", "Named{n}", 5, 7), ("Function", "Run{n}", 9, 11), ("Constant", "Limit", 13, 13)),
            ((3, "os", "stdlib"),),
        ),
    )),
    "Java": Sample("java", (
        Variant(
            "package p;\n\nimport java.util.List;\n\npublic class Box{n} {\n    private int side = 1;\n\n    public int area() {\n        return side;\n    }\n}\n",
            (("Class", "Box{n}", 5, 11), ("Variable", "side", 6, 6), ("Method", "area", 8, 10)),
            ((3, "java.util.List", "stdlib"),),
        ),
        Variant(
            "import org.junit.Test;\n\ninterface Named{n} {\n    String name();\n}\n\nenum Kind { A, B }\n",
            (("Interface", "Named{n}", 3, 5), ("Method", "name", 4, 4), ("Enum", "Kind", 7, 7)),
            ((1, "org.junit.Test", "external"),),
        ),
    )),
    "C": Sample("c", (
        Variant(
            '#include <stdio.h>\n#include "box{n}.h"\n\nstruct box{n} {\n  int side;\n};\n\nint area{n}(int a) {\n  return a;\n}\n',
            (("Struct", "box{n}", 4, 6), ("Variable", "side", 5, 5), ("Function", "area{n}", 8, 10)),
            ((1, "stdio.h", "stdlib"), (2, "box{n}.h", "internal")),
        ),
        Variant(
            "#define LIMIT{n} 3\nenum kind { A, B };\nunion value {\n  int i;\n};\n",
            (("Macro", "LIMIT{n}", 1, 1), ("Enum", "kind", 2, 2), ("Type", "value", 3, 5), ("Variable", "i", 4, 4)),
        ),
    )),
    "Cpp": Sample("cpp", (
        Variant(
            '#include <vector>\n#include "box{n}.h"\n\nnamespace n{n} {\nclass Box {\n  int area() {\n    return 1;\n  }\n};\n}\n',
            (("Namespace", "n{n}", 4, 10), ("Class", "Box", 5, 9), ("Method", "area", 6, 8)),
            ((1, "vector", "stdlib"), (2, "box{n}.h", "internal")),
        ),
        Variant(
            "struct Pair{n} {\n  int a;\n};\nenum class Kind { A, B };\nusing Small = short;\n",
            (("Struct", "Pair{n}", 1, 3), ("Variable", "a", 2, 2), ("Enum", "Kind", 4, 4), ("Type", "Small", 5, 5)),
        ),
    )),
    "CSharp": Sample("cs", (
        Variant(
            "using System;\nusing My.App{n};\n\nnamespace P{n}\n{\n    class Box\n    {\n        int Area() { return 1; }\n    }\n}\n",
            (("Namespace", "P{n}", 4, 10), ("Class", "Box", 6, 9), ("Method", "Area", 8, 8)),
            ((1, "System", "stdlib"), (2, "My.App{n}", "internal")),
        ),
        Variant(
            "interface INamed{n} { }\nstruct Pair { }\nenum Kind { A, B }\n",
            (("Interface", "INamed{n}", 1, 1), ("Struct", "Pair", 2, 2), ("Enum", "Kind", 3, 3)),
        ),
    )),
    "PHP": Sample("php", (
        Variant(
            "<?php\nnamespace P{n};\nuse App\\Models\\User{n};\n\nclass Box {\n    function area() {\n        return 1;\n    }\n}\n",
            (("Namespace", "P{n}", 2, 2), ("Class", "Box", 5, 9), ("Method", "area", 6, 8)),
            ((3, "App\\Models\\User{n}", "internal"),),
        ),
        Variant(
            "<?php\nrequire_once 'lib{n}.php';\ninterface Named{n} {}\ntrait Loud {}\nfunction sum{n}($a) {\n    return $a;\n}\n",
            (("Interface", "Named{n}", 3, 3), ("Trait", "Loud", 4, 4), ("Function", "sum{n}", 5, 7)),
            ((2, "lib{n}.php", "internal"),),
        ),
    )),
    "Ruby": Sample("rb", (
        Variant(
            "require 'json'\nrequire_relative 'lib{n}'\n\nmodule Outer\n  class Box{n}\n    def area\n      1\n    end\n  end\nend\n",
            (("Module", "Outer", 4, 10), ("Class", "Box{n}", 5, 9), ("Method", "area", 6, 8)),
            ((1, "json", "stdlib"), (2, "lib{n}", "internal")),
        ),
        Variant(
            "LIMIT{n} = 3\nclass Pair\n  attr_reader :left\nend\n",
            (("Constant", "LIMIT{n}", 1, 1), ("Class", "Pair", 2, 4), ("Property", "left", 3, 3)),
        ),
    )),
    "Kotlin": Sample("kt", (
        Variant(
            "import kotlin.math.abs\n\nclass Box{n} {\n    fun area(): Int {\n        return 1\n    }\n}\n",
            (("Class", "Box{n}", 3, 7), ("Method", "area", 4, 6)),
            ((1, "kotlin.math.abs", "stdlib"),),
        ),
        Variant(
            "interface Named{n} {\n}\nobject Single{n} {\n}\nval limit = 3\n",
            (("Interface", "Named{n}", 1, 2), ("Class", "Single{n}", 3, 4), ("Constant", "limit", 5, 5)),
        ),
    )),
    "Zig": Sample("zig", (
        Variant(
            'const std = @import("std");\nconst lib = @import("./lib{n}.zig");\n\nconst Box{n} = struct {\n    side: u32,\n};\n\nfn area{n}(a: u32) u32 {\n    return a;\n}\n',
            (("Constant", "std", 1, 1), ("Constant", "lib", 2, 2), ("Struct", "Box{n}", 4, 6), ("Constant", "Box{n}", 4, 6), ("Function", "area{n}", 8, 10)),
            ((1, "std", "stdlib"), (2, "./lib{n}.zig", "internal")),
        ),
        Variant(
            "const Kind{n} = enum { a, b };\nvar count: u32 = 0;\n",
            (("Enum", "Kind{n}", 1, 1), ("Constant", "Kind{n}", 1, 1), ("Variable", "count", 2, 2)),
        ),
    )),
    "Vue": Sample("vue", (
        Variant(
            "<template>\n  <p/>\n</template>\n<script>\nimport B from './B{n}.vue'\nfunction go{n}() {\n  return 1\n}\n</script>\n",
            (("Function", "go{n}", 6, 8),),
            ((5, "./B{n}.vue", "internal"),),
        ),
        Variant("<script>\nconst limit{n} = 3\n</script>\n", (("Constant", "limit{n}", 2, 2),)),
    )),
}
BLANKS = 5


def sources(documents: DataFrame, language: str) -> DataFrame:
    """A file (file_id, path, language, content) of a language for each document."""
    sample, n = SAMPLES[language], F.col("doc_id").cast("string")
    text = F.get(F.array(*[F.lit(v.text) for v in sample.variants]), F.pmod(F.col("doc_id"), F.lit(len(sample.variants))).cast("int"))
    content = F.concat(F.repeat(F.lit("\n"), F.pmod(F.col("doc_id"), F.lit(BLANKS)).cast("int")), F.replace(text, F.lit("{n}"), n))
    return documents.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/m"), "doc_id", F.lit(f".{sample.ending}")).alias("path"), F.lit(language).alias("language"), content.alias("content"))


def expected_sql(language: str, what: str) -> str:
    """DuckDB SQL for the rows of ``symbols`` or ``imports`` of the language's sources."""
    sample = SAMPLES[language]

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = [f"({i}, {', '.join(text(x) if isinstance(x, str) else str(x) for x in row)})" for i, v in enumerate(sample.variants) for row in getattr(v, what)]
    columns = "kind, symbol, a, b" if what == "symbols" else "a, symbol, kind"
    name = "replace(symbol, '{n}', doc_id::VARCHAR)"
    shift = f"doc_id % {BLANKS}"
    out = f"kind, {name} AS symbol, (a + {shift})::INT AS start_line, (b + {shift})::INT AS end_line" if what == "symbols" else f"(a + {shift})::INT AS line_number, {name} AS imported_path, kind AS import_type"
    return f"SELECT source || '/m' || doc_id || '.{sample.ending}' AS path, {out} FROM documents JOIN (VALUES {', '.join(rows)}) e(variant, {columns}) ON variant = doc_id % {len(sample.variants)}"
