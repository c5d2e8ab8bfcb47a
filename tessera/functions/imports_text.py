"""Imports, references and declarations of source text, read by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of import statements, references and what is stripped before references are read.
GO_BLOCK = r"(?m)^import\s*\(([^)]*)\)"
GO_ONE = r'(?m)^import\s+(?:([\w.]+)\s+)?"([^"\n]+)"'
GO_LINE = r'(?:^|\n)\s*(?:([\w.]+)\s+)?"([^"\n]+)"'
GO_STRIP = r"//[^\n]*|/\*(?s:.*?)\*/|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|`[^`]*`|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
GO_REFERENCE = r"(?<![\w.])([a-z][A-Za-z0-9_]*)\s*\.\s*([A-Z][A-Za-z0-9_]*)"
CS_USING = r"(?m)^\s*(?:global\s+)?using\s+(?!static\b)([A-Za-z_][\w.]*)\s*;"
CS_NAMESPACE = r"(?m)^\s*namespace\s+([A-Za-z_][\w.]*)"
CS_DECLARED = r"\b(?:class|struct|interface|enum|record)\s+([A-Z]\w*)"
CS_STRIP = r"//[^\n]*|/\*(?s:.*?)\*/|\$?@\"[^\"]*(?:\"\"[^\"]*)*\"|\$?\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
#: A type-like name, unless a call follows it; after ``new`` a call is a type.
CS_TYPE = r"(?<![\w.@])([A-Z][A-Za-z0-9_]*)(?![\w(])|(?<=new )([A-Z][A-Za-z0-9_]*)(?=\()"
CS_ATTRIBUTE = r"[\[,]\s?([A-Z][A-Za-z0-9_]*)\b"
HEAD_CHARS, PATH_CHARS = 200_000, 200


def sane_path(path: Column) -> Column:
    return (F.length(F.trim(path, F.lit("/"))) > 0) & ~path.rlike(r"[^\x00-\x7F]") & (F.length(path) < PATH_CHARS)


def go_imports(text: Column) -> Column:
    """array<struct<alias, path>> of a file's imports; alias is empty where there is none."""
    head = F.substring(text, 1, HEAD_CHARS)
    blocks = F.array_join(F.regexp_extract_all(head, F.lit(GO_BLOCK), F.lit(1)), "\n")

    def pairs(source: Column, pattern: str) -> Column:
        aliases, paths = (F.regexp_extract_all(source, F.lit(pattern), F.lit(i)) for i in (1, 2))
        return F.arrays_zip(aliases.alias("alias"), paths.alias("path"))

    every = F.concat(pairs(blocks, GO_LINE), pairs(head, GO_ONE))
    named = F.transform(every, lambda x: F.struct(x["alias"].alias("alias"), x["path"].alias("path")))
    return F.array_distinct(F.filter(named, lambda x: sane_path(x["path"])))


def go_package_names(path: Column) -> Column:
    """Names a package may go by, the likeliest first."""
    parts = F.split(path, "/")
    last = F.when((F.size(parts) > 1) & F.element_at(parts, -1).rlike(r"^v[0-9]+$"), F.get(parts, F.size(parts) - 2)).otherwise(F.element_at(parts, -1))
    plain = F.array_distinct(F.array(last, F.regexp_replace(last, r"\.v[0-9]+$", "")))

    def more(c: Column) -> Column:
        return F.filter(F.array(F.when(c.startswith("go-"), F.substring(c, F.lit(4), F.length(c))), F.when(c.endswith("-go") | c.endswith(".go"), F.substring(c, F.lit(1), F.length(c) - 3))), lambda x: x.isNotNull())

    def spelled(c: Column) -> Column:
        return F.array(c, F.replace(c, F.lit("-"), F.lit("_")), F.replace(c, F.lit("-"), F.lit("")), F.replace(c, F.lit("."), F.lit("_")), F.lower(c), F.lower(F.replace(c, F.lit("-"), F.lit(""))))

    every = F.concat(plain, F.flatten(F.transform(plain, more)))
    return F.array_distinct(F.filter(F.flatten(F.transform(every, spelled)), lambda x: x != ""))


def go_references(text: Column) -> Column:
    """array<struct<pkg, name>> of pkg.Name references outside comments and literals."""
    code = F.regexp_replace(text, GO_STRIP, " ")
    pkgs, names = (F.regexp_extract_all(code, F.lit(GO_REFERENCE), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.transform(F.arrays_zip(pkgs.alias("pkg"), names.alias("name")), lambda x: F.struct(x["pkg"].alias("pkg"), x["name"].alias("name"))))


def cs_usings(text: Column) -> Column:
    found = F.regexp_extract_all(F.substring(text, 1, HEAD_CHARS), F.lit(CS_USING), F.lit(1))
    return F.array_distinct(F.filter(found, sane_path))


def cs_namespace(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, CS_STRIP, " "), CS_NAMESPACE, 1)


def cs_declared(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, CS_STRIP, " "), F.lit(CS_DECLARED), F.lit(1)))


def cs_types(text: Column) -> Column:
    """Type-like names used but not declared in the file; attributes also by their full name."""
    code = F.regexp_replace(text, CS_STRIP, " ")
    plain, made = (F.regexp_extract_all(code, F.lit(CS_TYPE), F.lit(i)) for i in (1, 2))
    marks = F.transform(F.regexp_extract_all(code, F.lit(CS_ATTRIBUTE), F.lit(1)), lambda x: F.concat(x, F.lit("Attribute")))
    used = F.filter(F.array_distinct(F.concat(plain, made, marks)), lambda x: x != "")
    return F.array_except(used, cs_declared(text))


def importable(path: Column, language: str, standard: Column | None = None) -> Column:
    """Whether another project can import the path; ``standard`` tells Go's own packages."""
    short = ~path.rlike(r"[^\x00-\x7F]") & (F.length(path) < PATH_CHARS)
    if language == "go":
        parts = F.split(path, "/")
        module = F.contains(parts[0], F.lit(".")) & (F.size(parts) >= 2)
        return short & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ("internal", "vendor", "testdata")])) & ((standard if standard is not None else F.lit(False)) | module)
    return short & F.forall(F.split(path, r"\."), lambda p: p.rlike(r"^[\p{L}_]"))


def own_package(path: Column, repo: Column) -> Column:
    """True for a repository's own packages; ``repo`` is owner__name."""
    return F.startswith(F.lower(path), F.lower(F.concat(F.lit("github.com/"), F.replace(repo, F.lit("__"), F.lit("/")))))
